"""DuckDB twins of those pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from .conversations import ROLES
from .lookalikes import _tables
from .survivors import STAND_INS


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_quote(v) for v in values)


_BLANK = r"[\s\x00-\x1f\x7f-\x{A0}\x{AD}\x{200B}-\x{200F}\x{2000}-\x{200A}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _fold(c: str) -> str:
    source, target, many = _tables()
    c = f"nfc_normalize({c})"
    for other, latin in many:
        c = f"replace({c}, {_quote(other)}, {_quote(latin)})"
    # every character without a counterpart is dropped by translate
    return f"lower(nfc_normalize(trim(regexp_replace(translate({c}, {_quote(source)}, {_quote(target)}), '\\s+', ' ', 'g'))))"


def _best(field: str) -> str:
    order = "coalesce(trust_rank, 2147483647), updated_at desc nulls last, entry_id"
    return f"coalesce(first(entry_id order by {order}) filter (lower({_strip(field)}) not in ({_list(STAND_INS)})), 0)"


def oracle_sql() -> dict[str, str]:
    speaker = "case " + " ".join(f"when lower({_strip('role')}) in ({_list(s)}) then '{r[0]}'" for r, s in ROLES.items()) + " end"
    key = "replace(lower(trim({0})), '-', '_')"
    literal = r"""^\s*\{\s*(?:(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*:\s*[01](?:\.0*)?\s*(?:,\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*:\s*[01](?:\.0*)?\s*)*,?\s*)?\}\s*$"""
    pair = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*:\s*[01]"""
    return {
        "p1_found": f"""
            with e as (select l.*, {_fold("noun")} as k, o.trust_rank from lexicon_entries l left join lexicon_origins o on l.origin = o.origin)
            select min(entry_id) as first_entry_id, {_best("class")} as class_entry_id, {_best("subclass")} as subclass_entry_id
            from e where k <> '' group by k having count(*) > 1""",
        "p2_found": f"""
            with recursive rows_ as (
                select nullif({_strip("message_id")}, '') as id, nullif({_strip("parent_id")}, '') as parent, {speaker} as who, coalesce(regexp_matches(content, '[\\p{{L}}\\p{{N}}]'), false) as readable, ingested_at, created_at, content
                from messages),
            m as (select * from rows_ where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last, created_at desc nulls last, parent desc, who desc, content desc) = 1),
            leaf as (select id from m where id not in (select parent from m where parent is not null)),
            t as (
                select id as root, id, who, 1 as n, who as spoken, readable as good from m where parent is null
                union all
                select t.root, m.id, m.who, t.n + 1, t.spoken || coalesce(m.who, '?'), t.good and m.readable from t join m on m.parent = t.id),
            -- a conversation ends in a leaf, or in the message before it if the leaf is the user's
            ends as (
                select root, id as last, n, spoken, good from t where id in (select id from leaf) and who <> 'u'
                union
                select p.root, p.id, p.n, p.spoken, p.good from t l join m on m.id = l.id join t p on p.id = m.parent where l.id in (select id from leaf) and l.who = 'u')
            select root as root_id, last as last_id, cast(n as int) as n_messages from ends where good and regexp_full_match(spoken, 's?(ua)+')""",
        "p4_found": f"""
            with a as (select entry_id, lower(trim(noun, ' ')) as w, {_fold("noun")} as k from lexicon_entries), b as (select word_id, lower(trim(wordform, ' ')) as w, {_fold("wordform")} as k from tlfi_words)
            select entry_id, word_id from a join b using (k) where k <> '' and a.w <> b.w""",
        "p5_found": f"""
            with n as (select {key.format("source")} as k, count(distinct {_strip("instruction")}) as n from instruct_pairs where {_strip("instruction")} <> '' group by 1), size as (select count(*) // 4 as size from instruct_pairs)
            select source from sample_targets t cross join size left join n on n.k = {key.format("t.source")} where coalesce(n.n, 0) < greatest(min_rows, target_share * size)""",
        "p6_found": f"""
            with a as (select *, lower({_strip("annotator")}) as who from annotations where text_index is not null),
            good as (select text_index, who, annotator_annotation as given from a where regexp_matches(annotator_annotation, {_quote(literal)}) and who <> '' qualify row_number() over (partition by text_index, who order by annotated_at desc nulls last, annotator_annotation desc) = 1),
            votes as (select text_index, who, unnest(regexp_extract_all(given, {_quote(pair)})) as p from good),
            v as (select text_index, who, regexp_extract(p, '^.(.*?).\\s*:\\s*[01]$', 1) as noun, right(p, 1) = '1' as yes from votes),
            o as (select text_index, max(original_annotation) as original from a where regexp_matches(original_annotation, {_quote(literal)}) group by 1),
            items as (select text_index, unnest(regexp_extract_all(original, {_quote(pair)})) as p from o),
            i as (select text_index, regexp_extract(p, '^.(.*?).\\s*:\\s*[01]$', 1) as noun, right(p, 1) = '1' as yes from items)
            select text_index, noun from i join v using (text_index, noun) group by text_index, noun having count(*) >= 2 and 2 * count(*) filter (i.yes <> v.yes) > count(*)""",
        "p8_found": """
            with d as (select lower(trim(source)) as k, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) as tokens from documents where trim(regexp_replace(text, '\\s', '', 'g')) <> '' and trim(source) <> ''),
            s as (select k, sum(tokens) as tokens from d group by k), total as (select sum(tokens) as total from s)
            select source from mix_targets m cross join total left join s on s.k = lower(trim(m.source)) where coalesce(s.tokens, 0) * max_repeats < target_weight * total""",
    }
