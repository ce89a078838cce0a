"""Queries of readers, sinks, page parsers and single-step operators: each writes or builds its input from the test tables and reads it back."""

from __future__ import annotations

import pickle
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V
from genlex.operators import annotate, features, filters, lexicon, models, sampling
from genlex.session import shared_path, table, write_bytes
from genlex.sources import html, readers, writers

from .queries import TOKENS_SQL, _tokens, _values, query


# ---- sinks and scans, by round trip


@query("select entry_id, noun, origin from lexicon_entries")
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """K1 K6"""
    path = shared_path(spark)
    writers.write_table(table(spark, d, "lexicon_entries").select("entry_id", "noun", "origin"), path, "origin")
    return spark.read.schema("entry_id bigint, noun string, origin string").parquet(path)


@query("select n_nationkey, n_name from nation")
def pickle_scan(spark: SparkSession, d: str) -> DataFrame:
    """A pickle of the 25 nations, opened by the executors"""
    path = f"{shared_path(spark)}/nation.pkl"
    write_bytes(spark, path, pickle.dumps(table(spark, d, "nation").select("n_nationkey", "n_name").toPandas()))
    return readers.read_pickle(spark, path, "n_nationkey bigint, n_name string")


@query("select r_regionkey as k, coalesce(case when r_regionkey % 2 = 0 then r_name end, 'x') as v from region")
def sqlite_scan(spark: SparkSession, d: str) -> DataFrame:
    """A database of the five regions, opened by the executors"""
    db = sqlite3.connect(":memory:")
    db.execute("create table regions (k integer, a text, b text)")
    db.executemany("insert into regions values (?, ?, 'x')", [(r[0], r[1] if r[0] % 2 == 0 else None) for r in table(spark, d, "region").select("r_regionkey", "r_name").collect()])
    db.commit()
    path = f"{shared_path(spark)}/regions.db"
    write_bytes(spark, path, db.serialize())
    rows = readers.read_sqlite(spark, path, "regions", "k bigint, a string, b string")
    return rows.select("k", "a", "b").withColumn("v", F.coalesce("a", "b")).select("k", "v")


@query("select coalesce(parentword, wordform) as parentword from tlfi_words")
def value_scan(spark: SparkSession, d: str) -> DataFrame:
    """S3: the first non-null of two columns"""
    return readers.read_values(table(spark, d, "tlfi_words"), "parentword", "wordform")


@query("select c_custkey, c_name, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """S4 K9"""
    path = shared_path(spark)
    writers.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("select prenoms as Prenoms from first_names where prenoms is not null")
def first_name_scan(spark: SparkSession, d: str) -> DataFrame:
    """S5"""
    path = shared_path(spark)
    writers.write_csv(table(spark, d, "first_names").where("prenoms is not null").select(F.col("prenoms").alias("Prenoms")), path, ";")
    return readers.first_names(spark, path)


@query("select s_suppkey as k from supplier")
def first_column_scan(spark: SparkSession, d: str) -> DataFrame:
    """S6"""
    return readers.first_column(table(spark, d, "supplier").select("s_suppkey", "s_name")).withColumnRenamed("s_suppkey", "k")


def _json_array(spark: SparkSession, rows: DataFrame) -> str:
    """A file that holds the rows of a small fixed table as one JSON array."""
    path = f"{shared_path(spark)}/rows.json"
    write_bytes(spark, path, ("[" + ",".join(rows.toJSON().collect()) + "]").encode())
    return path


@query("select n_name from nation")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """S7 S8"""
    path = _json_array(spark, table(spark, d, "nation").select("n_nationkey", "n_name"))
    return readers.read_json_array(spark, path, "n_nationkey bigint, n_name string", "n_name")


@query("select 'e' || l_linenumber as custom_id, max(l_orderkey * 10 + l_linenumber) % 2 as v from lineitem group by l_linenumber")
def batch_output_scan(spark: SparkSession, d: str) -> DataFrame:
    """S9 over several files: of repeated ids the last line counts"""
    path, order = shared_path(spark), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    inner = F.concat(F.lit('{\\"a\\":'), (order % 2).cast("string"), F.lit("}"))
    value = F.concat(F.lit('{"custom_id":"e'), F.col("l_linenumber").cast("string"), F.lit('","response":{"body":{"choices":[{"message":{"content":"'), inner, F.lit('"}}]}}}'))
    writers.write_lines(table(spark, d, "lineitem").select(order.alias("o"), value.alias("value")).repartitionByRange(5, "o").sortWithinPartitions("o"), "value", path)
    return readers.read_batch_output(spark, path).select("custom_id", F.col("verdicts")["a"].cast("bigint").alias("v"))


@query("select noun from lexicon_entries where trim(noun, ' ') <> '' and not regexp_matches(noun, '[\\r\\n]')")
def line_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """S10 K10"""
    path = shared_path(spark)
    writers.write_lines(table(spark, d, "lexicon_entries").where(F.col("noun").isNotNull() & ~F.col("noun").rlike(r"[\r\n]")), "noun", path)
    return readers.read_lines(spark, path)


@query("select r_name as name from region union all select n_name from nation union all select r_name from region")
def merged_json_files(spark: SparkSession, d: str) -> DataFrame:
    """A missing file and one of another kind are skipped"""
    region = _json_array(spark, table(spark, d, "region").select(F.col("r_name").alias("name")))
    nation = _json_array(spark, table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return readers.merge_json(spark, [region, nation, f"{region}.none.json", f"{nation}.txt", _json_array(spark, table(spark, d, "region").select(F.col("r_name").alias("name")))], "name string")


@query("select s_suppkey, s_name, case when s_nationkey < 10 then s_nationkey end as s_nationkey from supplier")
def dataset_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits with different columns"""
    s, a, b = table(spark, d, "supplier"), shared_path(spark), shared_path(spark)
    s.where("s_nationkey < 10").select("s_suppkey", "s_name", "s_nationkey").write.parquet(a)
    s.where("s_nationkey >= 10").select("s_suppkey", "s_name").write.parquet(b)
    return readers.union_splits(spark, [a, b])


_DICT = r"^\{('[\p{L}]+': [01], )*'[\p{L}]+': [01]\}$"


@query(f"select text_index::varchar as text_index, annotator_annotation, len(regexp_extract_all(annotator_annotation, ': [01]')) as n from annotations where regexp_matches(original_annotation, '{_DICT.replace(chr(39), chr(39) * 2)}') and regexp_matches(annotator_annotation, '{_DICT.replace(chr(39), chr(39) * 2)}') and text_index is not null")
def annotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The sheet of complete annotations, written as TSV and read with both columns checked"""
    path = shared_path(spark)
    good = table(spark, d, "annotations").where(F.col("original_annotation").rlike(_DICT) & F.col("annotator_annotation").rlike(_DICT) & F.col("text_index").isNotNull())
    writers.write_csv(good.select(F.lit("d").alias("dataset"), F.col("text_index").cast("string").alias("text_index"), "text_index_dataset", F.lit("t").alias("text"), "original_annotation", "annotator_annotation"), path, "\t")
    out = readers.read_annotations(spark, path)
    return out.select("text_index", "annotator_annotation", F.size("annotator_annotation_map").cast("bigint").alias("n"))


@query("""select 'documents' as dataset, doc_id as text_index, 'documents_' || doc_id as text_index_dataset, text, '{"n":' || doc_id % 2 || '}' as original_annotation, '' as annotator_annotation from documents where text is not null""")
def annotator_sheet(spark: SparkSession, d: str) -> DataFrame:
    """K8"""
    docs = table(spark, d, "documents").where("text is not null")
    return writers.annotator_sheet(docs.select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("text_index"), F.concat(F.lit("documents_"), "doc_id").alias("text_index_dataset"), "text", F.create_map(F.lit("n"), F.col("doc_id") % 2).alias("real_human_nouns")))


@query("select n_name as wordForm from nation union all select r_name from region")
def word_files(spark: SparkSession, d: str) -> DataFrame:
    """Words by suffix"""
    words = _json_array(spark, table(spark, d, "nation").select(F.col("n_name").alias("wordForm")))
    path = f"{shared_path(spark)}/words.csv"
    names = [r[0] for r in table(spark, d, "region").select("r_name").collect()]
    write_bytes(spark, path, ("id,index,word,sum_prob\n" + "".join(f"{k},{k},{n},1.5\n" for k, n in enumerate(names))).encode())
    return readers.read_words(spark, words).select("wordForm").unionByName(readers.read_words(spark, path))


@query("select doc_id, source, text from documents where source is not null and text is not null")
def result_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """K2 K3"""
    path, docs = shared_path(spark), table(spark, d, "documents").where("source is not null and text is not null")
    writers.write_results(docs.select("doc_id", "text", "source", F.lit("real").alias("validated"), F.lit("g").alias("dataset_group"), F.col("source").alias("dataset")), path)
    return spark.read.schema("doc_id bigint, source string, text string, validated string, dataset_group string, dataset string").json(path).select("doc_id", "source", "text")


@query("select list(n_nationkey order by n_nationkey) as n_nationkey, list(n_name order by n_nationkey) as n_name from nation")
def column_arrays(spark: SparkSession, d: str) -> DataFrame:
    """K4 on the 25 nations"""
    return writers.column_arrays(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"])


@query("select concat_ws('_', source, pair_id, neutral) as custom_id, 'POST' as method, 'm' as model, 'user' as role, instruction as content, 1500 as max_tokens from instruct_pairs where instruction is not null")
def request_lines(spark: SparkSession, d: str) -> DataFrame:
    """K5: written as lines and parsed again"""
    path = shared_path(spark)
    pairs = table(spark, d, "instruct_pairs").where("instruction is not null").select(F.col("pair_id").alias("i"), "instruction", "source", "neutral")
    writers.write_lines(writers.batch_requests(pairs, "m"), "value", path)
    schema = "custom_id string, method string, url string, body struct<model: string, messages: array<struct<role: string, content: string>>, max_tokens: int, temperature: double>"
    j = readers.read_lines(spark, path, "value").select(F.from_json("value", schema).alias("j"))
    return j.select("j.custom_id", "j.method", "j.body.model", F.col("j.body.messages")[0]["role"].alias("role"), F.col("j.body.messages")[0]["content"].alias("content"), "j.body.max_tokens")


@query("select completewordform as completeWordForm, wordform as wordForm, url, case when parentword is not null then parentword end as parentWord from tlfi_words")
def entry_insert(spark: SparkSession, d: str) -> DataFrame:
    """K7"""
    t = table(spark, d, "tlfi_words")
    nested = t.select(F.col("completewordform").alias("completeWordForm"), F.col("wordform").alias("wordForm"), F.col("wordtype").alias("wordType"), F.array("wordtype").alias("wordDefinitionFeatures"), "etyhist", F.array("wordform").alias("derives"), "url", F.lit(None).cast("string").alias("parentCompleteWord"), F.col("parentword").alias("parentWord"))
    return writers.entry_rows(nested).select("completeWordForm", "wordForm", "url", "parentWord")


# ---- page parsers


_NAMES = "select s_suppkey as page, s_name as name from supplier"


def _pages(spark: SparkSession, d: str, *parts) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"))


@query(f"with n as ({_NAMES}) select page, name as demonym from n union all select page, 'b' || page from n")
def demonym_pages(spark: SparkSession, d: str) -> DataFrame:
    """S15 X2"""
    pages = _pages(spark, d, "<table><tr><th>x<th>y<th>z</tr><tr><td>1</td><td>2</td><td> ", F.col("s_name"), ", <b>b", F.col("s_suppkey").cast("string"), "</b> (rare), never</td></tr><tr><td>short</td></tr></table>")
    return html.demonyms(pages, "html", "page")


@query(f"with n as ({_NAMES}) select page, 0 as pos, name as noun from n union all select page, 1, 'autre' from n")
def noun_pages(spark: SparkSession, d: str) -> DataFrame:
    """S16"""
    pages = _pages(spark, d, "<h2>A</h2><p><b>Noms :</b> <a>", F.col("s_name"), "</a>, <a>autre</a></p><p><a>none</a></p><h2>B</h2><p><b>noms</b><a>hidden</a></p>")
    return html.pages_to_rows(pages, "html", html.section_nouns(("A",)), "pos int, noun string", "page")


@query("with n as (select distinct string_split(s_name, '#')[1] as animal from supplier) select animal from n")
def animal_pages(spark: SparkSession, d: str) -> DataFrame:
    """Positions over all pages; nothing after the first stop word"""
    first = F.split("s_name", "#")[0]
    pages = _pages(spark, d, "<table class='wikitable big'><tr><th>x</th></tr><tr><td><a>", first, " suite</a> rest</td></tr></table><table><tr><th></th></tr><tr><td>none</td></tr></table>")
    rows = html.pages_to_rows(pages, "html", html.animals, "pos int, animal string", "page")
    return html.animal_names(rows.select((F.col("page") * 1000 + F.col("pos")).alias("pos"), "animal"))


@query("select c_custkey as entity, c_name as entityLabel, 'f' || c_custkey as entity_female_label, case when c_custkey % 3 = 0 then 'm' || c_custkey end as entity_male_label from customer where c_custkey % 5 <> 0")
def gendered_labels(spark: SparkSession, d: str) -> DataFrame:
    """S18"""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    title = F.when(k % 5 == 0, "titre de noblesse").when(k % 5 == 1, "métier")
    entities = c.select(k.alias("entity"), F.col("c_name").alias("entityLabel"), title.alias("description"))
    return lexicon.gendered_labels(entities, c.select(k.alias("entity"), F.concat(F.lit("f"), k).alias("label")), c.where(k % 3 == 0).select(k.alias("entity"), F.concat(F.lit("m"), k).alias("label")))


@query(f"with n as ({_NAMES}) select page, 0 as pos, 'Une personne' as definition, '[' || name || ']' as bracket_text, '' as indicator, 'dom' as domain, '' as phrase from n union all select page, 1, name, '[' || name || ']', '', '', 'ph' from n")
def definition_pages(spark: SparkSession, d: str) -> DataFrame:
    """The nearest context, up to three levels up"""
    pages = _pages(spark, d, "<div><span class='tlf_ccrochet'>[", F.col("s_name"), "]</span><div><p><span class='tlf_cdomaine'>dom</span><span class='tlf_cdefinition'>Une personne :</span></p><p><span class='tlf_csyntagme'>ph</span><span class='tlf_cdefinition'>", F.col("s_name"), "</span></p></div></div>")
    return html.pages_to_rows(pages, "html", html.definitions, "pos int, definition string, bracket_text string, indicator string, domain string, phrase string", "page")


@query("select s_suppkey, s_name as example, 'A. ' || s_suppkey as author, 'T, t. 2' as title, '1900' as date from supplier")
def example_parts(spark: SparkSession, d: str) -> DataFrame:
    """D13 D14"""
    page = F.concat(F.lit("1. <i>"), "s_name", F.lit('</i> <span class="tlf_cauteur"> <b>A. '), F.col("s_suppkey").cast("string"), F.lit('</b></span><span class="tlf_ctitre">T,t. 2,</span><span class="tlf_cdate"> 1900,</span>'))
    return table(spark, d, "supplier").select("s_suppkey", T.example_parts(page).alias("p")).select("s_suppkey", "p.*")


@query("select s_suppkey, s_name as bare, s_name as cut from supplier")
def stripped_content(spark: SparkSession, d: str) -> DataFrame:
    """D14"""
    return table(spark, d, "supplier").select("s_suppkey", T.strip_content(F.concat(F.lit(" <b class='x'>"), "s_name", F.lit("</b> "))).alias("bare"), T.strip_content(F.concat(F.lit(", <b>"), "s_name", F.lit("</b>,")), True).alias("cut"))


@query("select p_partkey, case when p_partkey % 4 <> 0 then p_size::int end as first, case when p_partkey % 4 <> 0 then (p_size + 9)::int end as last, case when p_partkey % 4 <> 0 then p_partkey::int end as total from part")
def result_count_lines(spark: SparkSession, d: str) -> DataFrame:
    """D18"""
    line = F.when(F.col("p_partkey") % 4 == 0, "aucun résultat").otherwise(F.format_string("<p>Résultats %d à %d/%d</p>", F.col("p_size").cast("int"), (F.col("p_size") + 9).cast("int"), F.col("p_partkey").cast("int")))
    return table(spark, d, "part").select("p_partkey", T.result_counts(line).alias("r")).select("p_partkey", "r.first", "r.last", "r.total")


# ---- single-step operators


@query("select entry_id, class from lexicon_entries where class in ('', 'Aucun', 'aucun', '?')")
def value_filter(spark: SparkSession, d: str) -> DataFrame:
    """F2"""
    return filters.value_in(table(spark, d, "lexicon_entries").select("entry_id", "class"), "class", ("", "Aucun", "aucun", "?"))


@query("with e as (select noun, entry_id % 3 = 0 as epicene, entry_id % 4 = 0 as proper from lexicon_entries) select noun from e where epicene and not proper union all select lower(noun) from e where epicene and not proper union all select 'médecin'")
def epicene_words(spark: SparkSession, d: str) -> DataFrame:
    """Flags made from keys; the list beside the plain filter"""
    flag = lambda n: (F.col("entry_id") % n == 0).cast("int")
    rows = table(spark, d, "lexicon_entries").select(F.col("noun").alias("__dmnt__nm"), flag(3).alias("__dmnt__epicene"), flag(4).alias("__dmnt__proper_noun"))
    return lexicon.union_all(lexicon.epicene_nouns(rows), lexicon.epicene_list(rows))


@query("with g as (select p_partkey, case p_partkey % 5 when 0 then 0 when 4 then null else p_partkey % 5 end as rank from part) select p_partkey, rank::int as rank from g where rank <= 2")
def sense_ranks(spark: SparkSession, d: str) -> DataFrame:
    """F5"""
    k = F.col("p_partkey") % 5
    gloss = F.when(k == 0, '{"__item": "a", "__item9": "b"}').when(k == 4, '{"bad": 1}').otherwise(F.concat(F.lit('{"x_item'), k.cast("string"), F.lit('": "a"}')))
    return table(spark, d, "part").select("p_partkey", T.sense_rank(gloss).alias("rank")).where("rank <= 2")


@query("select doc_id from documents where not contains(text, 'chaque')")
def without_word_part(spark: SparkSession, d: str) -> DataFrame:
    """F6"""
    return filters.without_substring(table(spark, d, "documents"), "text", "chaque").select("doc_id")


@query("select instruction, output from instruct_pairs")
def content_columns(spark: SparkSession, d: str) -> DataFrame:
    """F11"""
    pairs = table(spark, d, "instruct_pairs")
    return pairs.select(*filters.content_columns("oracle", pairs.columns))


@query("select message_id, content from messages")
def columns_of_type(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    m = table(spark, d, "messages")
    return m.select("message_id", *filters.columns_of_type(m.columns, "content"))


_GROUPS = [(n, g) for g, ns in V.DATASET_GROUPS.items() for n in ns]


@query(f"select pair_id, g as dataset_group from instruct_pairs join (values {_values(_GROUPS)}) t(n, g) on source = n")
def dataset_groups(spark: SparkSession, d: str) -> DataFrame:
    """F13"""
    pairs = filters.value_in(table(spark, d, "instruct_pairs"), "source", [n for n, _ in _GROUPS])
    return pairs.select("pair_id", T.dataset_group(F.col("source")).alias("dataset_group"))


@query("select author_id, doc_id as text_index, lang from documents")
def shaped_columns(spark: SparkSession, d: str) -> DataFrame:
    """F17"""
    return filters.shape_columns(table(spark, d, "documents"), {"doc_id": "text_index"}, ("text", "source", "n_chars", "collected_at"), ("author_id",))


@query("select text_index, regexp_replace(text_index_dataset, '_[0-9]+$', '') as dataset from annotations")
def dataset_names(spark: SparkSession, d: str) -> DataFrame:
    """F19"""
    return table(spark, d, "annotations").select("text_index", T.dataset_of(F.col("text_index_dataset")).alias("dataset"))


@query("select noun from (select distinct noun[1:1] as c, noun from (select lower(trim(noun, ' ')) || 'e' as noun, entry_id from lexicon_entries where entry_id % 3 = 0 and noun is not null)) where regexp_matches(c, '^\\p{Ll}') and noun not in (select lower(wordform) from tlfi_words where wordform is not null)")
def feminine_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms and tags made from the lexicon's nouns; tags of every third entry say feminine"""
    lex = table(spark, d, "lexicon_entries").where("noun is not null")
    forms = F.to_json(F.create_map(F.lit("forms_1_form"), F.concat(F.lower(F.trim("noun")), F.lit("e")), F.lit("forms_2_form"), F.lit("never")))
    tags = F.when(F.col("entry_id") % 3 == 0, '{"forms_1_tags": "feminine singular", "forms_2_tags": "plural"}').when(F.col("entry_id") % 3 == 1, "{broken").otherwise('{"forms_1_tags": "masculine"}')
    return lexicon.feminine_forms(lex.select(forms.alias("forms_json"), tags.alias("tags_json")), table(spark, d, "tlfi_words").select("wordform").where("wordform is not null"))


@query("select pair_id, instruction, case when pair_id % 2 = 0 then neutral end as neutral from instruct_pairs")
def assigned_column(spark: SparkSession, d: str) -> DataFrame:
    """J13"""
    pairs = table(spark, d, "instruct_pairs")
    return filters.assign_by_id(pairs.select("pair_id", "instruction", F.lit(9).alias("neutral")), pairs.where("pair_id % 2 = 0"), "pair_id", "neutral")


@query(f"select word, row_number() over (order by length(word) desc, i)::int as place from (select unnest([{', '.join(chr(39) + w + chr(39) for w in V.FEMININE_ENDINGS)}]) as word, generate_subscripts([{', '.join(chr(39) + w + chr(39) for w in V.FEMININE_ENDINGS)}], 1) as i)")
def endings_longest_first(spark: SparkSession, d: str) -> DataFrame:
    """The order of the alternatives"""
    return spark.createDataFrame([(w, k + 1) for k, w in enumerate(T._longest_first(V.FEMININE_ENDINGS).split("|"))], "word string, place int")


@query("select source, lang from documents union all select source, lang from instruct_pairs")
def union_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """U1"""
    return lexicon.union_all(*[table(spark, d, t).select("source", "lang") for t in ("documents", "instruct_pairs")])


@query("select distinct message_id, parent_id, user_id, role, content, lang from messages")
def distinct_messages(spark: SparkSession, d: str) -> DataFrame:
    """U5"""
    return lexicon.distinct_rows(table(spark, d, "messages").select("message_id", "parent_id", "user_id", "role", "content", "lang"))


@query("select distinct source from instruct_pairs where source is not null")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """U6"""
    return lexicon.distinct_column(table(spark, d, "instruct_pairs"), "source")


@query("select pair_id, source from instruct_pairs")
def shuffled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """G3"""
    return sampling.shuffled(table(spark, d, "instruct_pairs").select("pair_id", "source"), ["pair_id"])


@query(f"with {TOKENS_SQL} select distinct text_id from tokens where lower(text) = 'qui' and pos = 'PRON' and i % 3 <> 2 and i % 2 = 0")
def interrogative_who(spark: SparkSession, d: str) -> DataFrame:
    """T5: dependency and morphology made from the place in the text"""
    i = F.col("i")
    dep = F.when(i % 3 == 0, "nsubj").when(i % 3 == 1, "ROOT").otherwise("det")
    kinds = F.create_map(F.lit("PronType"), F.when(i % 2 == 0, "Rel,Int").otherwise("Rel"))
    return filters.interrogative_who(_tokens(spark, d).withColumns({"dep": dep, "morph": kinds}))


_SENTENCE = f"'Toute sa vie durant, ' || case when contains('{V.VOWELS}', noun[1]) or (noun[1] = 'h' and noun not in ('hibou')) then 'l''' else 'le' end || ' ' || noun || ' n''a fait qu''essuyer les échecs.'"


@query(f"select entry_id, {_SENTENCE} as sentence from lexicon_entries where noun is not null and noun <> ''")
def carrier_sentences(spark: SparkSession, d: str) -> DataFrame:
    """T19"""
    return table(spark, d, "lexicon_entries").where("noun <> ''").select("entry_id", T.generic_sentence(F.col("noun"), ["hibou"]).alias("sentence"))


def _load_labels():
    """A stand-in for a model: persons in sentences with ``durant, l'``, places by themselves if they are long."""
    return lambda texts: ["PER" if "durant, l'" in t else "LOC" if len(t) > 12 and " durant" not in t else "" for t in texts]


@query(f"select noun, case when contains({_SENTENCE}, 'durant, l''') then 'PER' when length(noun) > 12 then 'LOC' else '' end as label from lexicon_entries where noun <> ''")
def noun_labels(spark: SparkSession, d: str) -> DataFrame:
    """T20"""
    return annotate.label_nouns(table(spark, d, "lexicon_entries"), _load_labels, ["hibou"])


def _load_blanks():
    """A stand-in for a model: words between single spaces."""
    return lambda texts: [[(0, w, w.lower(), "X", "", {"len": str(len(w))}) for w in t.split(" ")] for t in texts]


@query("select doc_id::varchar as text_id, (generate_subscripts(string_split(text, ' '), 1) - 1)::int as i, unnest(string_split(text, ' ')) as text from documents where text is not null")
def model_tokens(spark: SparkSession, d: str) -> DataFrame:
    """X3"""
    return annotate.model_annotate(table(spark, d, "documents"), "doc_id", "text", _load_blanks).select("text_id", "i", "text")


@query("select vec_id, round(7 * 0.5 + list_sum(list_transform(embedding, lambda x: x::double)), 6) as total, 7 + len(embedding) as width from embeddings")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """H7"""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", *[F.lit(0.5).alias(c) for c in features.FEATURES])
    m = features.feature_matrix(e, "embedding")
    return m.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("features").cast("bigint").alias("width"))


def _load_scores():
    """A stand-in for a model: the share of vowels."""
    return lambda words: [round(sum(c in "aeiou" for c in w) / max(1, len(w)), 6) for w in words]


@query("select noun as word, (q >= 0.5)::int as prediction, q as probability from (select noun, round(len(regexp_extract_all(noun, '[aeiou]')) / greatest(1, length(noun)), 6) as q from lexicon_entries where noun is not null)")
def external_predictions(spark: SparkSession, d: str) -> DataFrame:
    """H10"""
    return models.predict_external(table(spark, d, "lexicon_entries").where("noun is not null").select(F.col("noun").alias("word")), _load_scores)


@query("with w as (select case when not regexp_matches(etyhist, '^\\s*$') then etyhist end as male, regexp_split_to_array(trim(completewordform, ' '), '\\s+')[1] as label from tlfi_words) select noun as word, 1 as label from (select coalesce(male, label) as noun from w union select noun from lexicon_entries union select prenoms from first_names) where noun is not null and not regexp_matches(noun, '[(·]')")
def positive_words(spark: SparkSession, d: str) -> DataFrame:
    """H12 F9"""
    t = table(spark, d, "tlfi_words").select(F.col("etyhist").alias("entity_male_label"), F.col("completewordform").alias("entityLabel"))
    return features.positive_words(t, table(spark, d, "lexicon_entries").select("noun"), table(spark, d, "first_names"))


_NODE = "case p_partkey % 4 when 0 then 'person.n.01' when 1 then 'artifact.n.01' when 2 then 'living_thing.n.01' else 'object.n.01' end"


@query(f"""with p as (select 'part_' || (case p_partkey % 97 when 1 then 'x1' else chr((97 + p_partkey % 26)::int) end) as word, p_partkey % 11 as synset, {_NODE} as node from part),
    s as (select word, synset, bool_or(node = 'person.n.01') as h, bool_or(node = 'artifact.n.01') as a, bool_or(node = 'living_thing.n.01') as l from p group by 1, 2)
    select distinct replace(word, '_', ' ') as word, case when a then 'artifact' when l then 'living_being' else 'object' end as label from s where not h and not regexp_matches(word, '[0-9]') and replace(word, '_', ' ') <> 'part b'""")
def negative_words(spark: SparkSession, d: str) -> DataFrame:
    """Paths made from keys"""
    k = F.col("p_partkey")
    word = F.concat(F.lit("part_"), F.when(k % 97 == 1, "x1").otherwise(F.char(97 + k % 26)))
    node = F.when(k % 4 == 0, "person.n.01").when(k % 4 == 1, "artifact.n.01").when(k % 4 == 2, "living_thing.n.01").otherwise("object.n.01")
    return features.negative_words(table(spark, d, "part").select(word.alias("word"), (k % 11).alias("synset"), node.alias("node")), spark.createDataFrame([("part b",)], "word string"), category=True)
