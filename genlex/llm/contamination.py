"""Problem 7: documents that contain text of evaluation items, whole or in part, exactly or edited.

Method: rare n-gram seeds join documents to items, then Smith-Waterman alignment on words scores the edited copies. The seed
length is the longest run of words that every qualifying passage must leave intact, so seeds are as long as they can be
without losing a case: of 20 words with at most one in eight swapped, some six in a row are untouched. How rare a seed is comes
from its document frequency. One that too large a share of the documents has (a stock phrase) joins nothing by itself: it
counts only together with a second run of the item near it, which every qualifying passage must have too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.session import materialize

from .lookalikes import _tables, compose

MATCH, MISMATCH, GAP = 2, -2, -2
MAX_BROADCAST_SEEDS = 4_000_000  # 8 bytes each: above it the seeds are joined by shuffle
PAIRS_PER_TASK = 2048  # alignment is arithmetic on few bytes: tasks are cut by number of pairs, not by size, each of about a second
ITEMS_PER_SHARE = 64  # a document with more candidates is split over several tasks
STRETCH = 4096  # tokens of a document that are aligned at once: memory is bounded by this times the item
INLINE = "i|b|em|strong|u|s|span|a|sup|sub|small|mark|font|q|cite|abbr|code"
TOKEN = r"[\p{L}\p{N}\p{M}]+"


def _where(text: Column, sign, change) -> Column:
    """``change`` of the texts that have a ``sign``, others as they are; the text is computed once."""
    return F.transform(F.array(text), lambda t: F.when(sign(t), change(t)).otherwise(t))[0]


def plain_text(text: Column) -> Column:
    """Lower-case text without markup, note marks, invisible and look-alike characters, in composed characters.

    Most texts have nothing of some of these: a look for the first sign of them is cheaper than the replacement.
    """
    source, target, _ = _tables()
    tags = lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?i)</?(?:{INLINE})(?:\s[^<>]*)?>", ""), r"<[/!a-zA-Z][^<>]*>", " ")
    text = _where(text, lambda t: F.contains(t, F.lit("<")), tags)
    text = _where(text, lambda t: F.contains(t, F.lit("&")), lambda t: F.regexp_replace(t, r"&(?:nbsp|amp|quot|apos|lt|gt|laquo|raquo|#\d{1,6}|#x[0-9a-fA-F]{1,6});", " "))
    text = _where(text, lambda t: t.rlike(r"[\[⁰¹²³⁴-⁹]"), lambda t: F.regexp_replace(t, r"\[(?:\d{1,3}|[a-z]|note \d{1,3})\]|[⁰¹²³⁴-⁹]+", ""))
    return F.lower(F.transform(F.array(F.translate(text, source, target)), compose)[0])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(plain_text(text), F.lit(f"({TOKEN})"), F.lit(1))


def words_of_tokens(text: Column) -> Column:
    """``array<struct<t, w>>``: the tokens with the number of the blank-separated word they belong to."""
    words = F.filter(F.split(plain_text(text), r"\s+"), lambda w: w.rlike(TOKEN))
    return F.flatten(F.transform(words, lambda w, i: F.transform(F.regexp_extract_all(w, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.struct(t.alias("t"), i.alias("w")))))


def seed_length(n_words: int, least_words: int, one_in: int) -> int:
    """The run of intact words that any passage of at least min(n_words, least_words) words must have if one word in ``one_in`` may differ."""
    runs = []
    for n in range(min(n_words, least_words), n_words + 1):
        swaps = n // one_in
        runs.append(-(-(n - swaps) // (swaps + 1)))
    return max(1, min(runs))


def seed_lengths(n_words: Column, least_words: int, one_in: int) -> Column:
    """``seed_length`` of a column: from ``least_words`` on it is one number, the least of all longer items (it only rises from period to period)."""
    floor = min(seed_length(n, least_words, one_in) for n in range(least_words, least_words + one_in * least_words))
    swaps = F.floor(n_words / one_in)
    return F.when(n_words >= least_words, floor).otherwise(F.greatest(F.lit(1), F.ceil((n_words - swaps) / (swaps + 1)))).cast("int")


def context_length(least_words: int, one_in: int) -> int:
    """The second run of intact words, beside any seed, that a passage must have within the reach of ``2 least_words`` words.

    A longer passage cut into pieces of ``least_words`` to ``2 least_words`` - 1 words has a piece with no larger share of
    changed words, so it is enough to look at these: s changes and the seed part the rest of the piece into s + 2 runs.
    """
    n_seed = min(seed_length(n, least_words, one_in) for n in range(least_words, least_words + one_in * least_words))
    return min(-(-(n - n_seed - n // one_in) // (n // one_in + 2)) for n in range(least_words, 2 * least_words))


def runs(toks: Column, n: int) -> Column:
    """Hashes of all runs of n tokens, in their order; runs of tokens that are hashed already cost n numbers each."""
    starts = F.when(F.size(toks) >= n, F.sequence(F.lit(0), F.size(toks) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(toks, i + k) for k in range(n)]))


def grams(toks: Column, n: int) -> Column:
    """Hashes of all runs of n tokens, distinct."""
    return F.array_distinct(runs(toks, n))


def seed_contexts(toks: Column, words: Column, seeds: Column | None, n: int, c: int, reach: int) -> Column:
    """``array<struct<gram, near>>``, distinct: each seed (only those in ``seeds`` if given) with the hash of each run of ``c`` tokens beside it,
    at most ``reach`` words away. ``words``: number of the word of each token."""
    near = runs(toks, c)
    own = F.transform(runs(toks, n), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    if seeds is not None:
        own = F.filter(own, lambda x: F.array_contains(seeds, x["g"]))

    def beside(x: Column) -> Column:
        # a word has at least one token, so the runs within reach lie within reach x the most tokens of a word; words tell exactly
        others = F.filter(F.transform(near, lambda h, j: F.struct(h.alias("h"), j.alias("j"))), lambda y: ((y["j"] + c <= x["i"]) | (y["j"] >= x["i"] + n)) & (F.abs(F.get(words, y["j"]) - F.get(words, x["i"])) <= reach))
        return F.transform(others, lambda y: F.struct(x["g"].alias("gram"), y["h"].alias("near")))

    return F.array_distinct(F.flatten(F.transform(own, beside)))


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Smith-Waterman with linear gaps: (score, columns) of a best local alignment; a column is (doc, item) with -1 for a gap."""
    n, m = len(doc), len(item)
    table = np.zeros((m + 1, n + 1), dtype=np.int32)
    ramp = -GAP * np.arange(n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        row = np.maximum(table[i - 1] + GAP, 0)
        np.maximum(row[1:], table[i - 1, :-1] + np.where(doc == item[i - 1], MATCH, MISMATCH), out=row[1:])
        table[i] = np.maximum.accumulate(row + ramp) - ramp  # gaps along the document
    flat = int(table.argmax())
    i, j = divmod(flat, n + 1)
    score, columns = int(table[i, j]), []
    while i > 0 and j > 0 and table[i, j] > 0:
        step = MATCH if doc[j - 1] == item[i - 1] else MISMATCH
        if table[i, j] == table[i - 1, j - 1] + step:
            columns.append((j - 1, i - 1))
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            columns.append((-1, i - 1))
            i -= 1
        else:
            columns.append((j - 1, -1))
            j -= 1
    return score, columns[::-1]


def longest_window(columns: list[tuple[int, int]], doc: np.ndarray, item: np.ndarray, word: np.ndarray, one_in: int) -> tuple[int, int]:
    """(words, differing words) of the longest stretch of the item in this alignment in which at most one word in ``one_in`` differs.

    A word differs if one of its tokens is changed or missing; text put in between two intact words counts as one more. Words at
    the edges that are changed lie outside a local alignment, so the stretch may go on there over changed words as far as the
    document and the allowance do.
    """
    n_words, left_room, right_room = int(word[-1]) + 1, columns[0][0], len(doc) - 1 - max(j for j, _ in columns)
    same, got = np.zeros(len(item), dtype=bool), np.zeros(len(item), dtype=bool)
    extra = np.zeros(n_words + 1, dtype=np.int64)
    for at, (j, i) in enumerate(columns):
        if i >= 0:
            got[i], same[i] = True, j >= 0 and doc[j] == item[i]
        else:
            before = next(k for _, k in reversed(columns[:at]) if k >= 0)
            if before + 1 < len(item) and word[before + 1] != word[before]:
                extra[word[before + 1]] = 1
    broken = np.zeros(n_words, dtype=np.int64)
    np.maximum.at(broken, word, (~same).astype(np.int64))
    first, last = int(word[columns[0][1]]), int(word[max(i for _, i in columns)])
    cost = broken.copy()
    for w in range(1, n_words):
        if extra[w] and not broken[w] and not broken[w - 1]:
            cost[w] += 1
    lo, hi = max(0, first - min(left_room, n_words)), min(n_words - 1, last + min(right_room, n_words))
    total = np.concatenate([[0], np.cumsum(cost[lo : hi + 1])])
    best = (0, 0)
    for a in range(hi - lo + 1):
        for b in range(hi - lo + 1, a + best[0], -1):
            differ = int(total[b] - total[a])
            if differ * one_in <= b - a:
                best = (b - a, differ)
                break
    return best


def can_hold(part: np.ndarray, item: np.ndarray, word: np.ndarray, need: int, one_in: int) -> bool:
    """Whether enough words of the item occur in this stretch at all; False rules a passage out exactly.

    A passage of n words has at most n / one_in words that do not occur. Cut into pieces of ``need`` to 2 ``need`` - 1 words, one
    piece has no larger share of them, so looking at windows of these lengths is enough. Tokens are numbered from 0 by the item.
    """
    there = np.zeros(int(item.max()) + 1, dtype=bool)
    there[part[part >= 0]] = True
    absent = np.zeros(int(word[-1]) + 1, dtype=np.int64)
    absent[word[~there[item]]] = 1
    if len(absent) - int(absent.sum()) < need - need // one_in:
        return False
    total = np.concatenate([[0], np.cumsum(absent)])
    return any((total[n:] - total[:-n]).min() * one_in <= n for n in range(need, min(2 * need - 1, len(absent)) + 1))


def stretches(doc: np.ndarray, item: np.ndarray, n: int, one_in: int, limit: int = STRETCH) -> list[tuple[int, int]]:
    """Stretches of the document round the seeds, so that long documents are aligned only where the item can be.

    Touching ones are joined, and joined ones longer than ``limit`` cut with overlaps that hold any passage whole.
    """
    seeds = {item[k : k + n].tobytes() for k in range(len(item) - n + 1)}
    reach = len(item) + len(item) // one_in + 8
    known = np.concatenate([[0], np.cumsum(doc >= 0)])  # words that the item lacks are negative
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(known[n:] - known[:-n] == n).tolist() if len(doc) >= n else []:
        if doc[k : k + n].tobytes() in seeds:
            a, b = max(0, k + n - reach), min(len(doc), k + n + reach)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    limit = max(limit, 4 * reach)
    return [(a, min(a + limit, hi)) for lo, hi in out for a in range(lo, max(lo + 1, hi - 2 * reach), limit - 2 * reach)]


def _score(least_words: int, one_in: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, prepared = [], {}
            for doc_id, item_id, doc_toks, item_toks, item_words, n in zip(pdf["doc_id"], pdf["item_id"], pdf["doc_toks"], pdf["item_toks"], pdf["item_words"], pdf["n"], strict=True):
                if item_id not in prepared:
                    code: dict[str, int] = {}
                    item = np.array([code.setdefault(t, len(code)) for t in item_toks], dtype=np.int64)
                    prepared[item_id] = code, item, np.asarray(item_words, dtype=np.int64)
                code, item, word = prepared[item_id]
                doc = np.fromiter((code.get(t, -1) for t in doc_toks), dtype=np.int64, count=len(doc_toks))
                n_words = int(word[-1]) + 1
                need = min(least_words, n_words)
                least_score = max(MATCH, (need - need // one_in) * MATCH + (need // one_in) * 2 * MISMATCH)
                best = (0, 0, 0)
                for a, b in stretches(doc, item, int(n), one_in):
                    part = doc[a:b].copy()
                    # the best alignment need not be the one that holds the passage: go on with the rest of the stretch
                    while can_hold(part, item, word, need, one_in):
                        score, columns = align(part, item)
                        if score < least_score:
                            break
                        length, differ = longest_window(columns, part, item, word, one_in)
                        if length >= need:
                            best = max(best, (length, -differ, score))
                        used = [j for j, _ in columns if j >= 0]
                        part[used] = -2
                if best[0]:
                    rows.append((doc_id, item_id, best[0], -best[1], best[2], n_words))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_changed", "score", "item_words"]).astype({"n_words": "int32", "n_changed": "int32", "score": "int32", "item_words": "int32"})

    return run


def _seeds(prepared: DataFrame, sizes: list[int]) -> DataFrame:
    """``(item_id, gram)``: the runs of each item by its own seed length."""
    parts = [prepared.where(F.col("n") == n).select("item_id", F.explode(grams(F.col("hashes"), n)).alias("gram")) for n in sizes]
    return reduce(DataFrame.unionByName, parts)


def _small(df: DataFrame) -> DataFrame:
    """Written data with a broadcast hint if its counted size allows it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_SEEDS else df


def leaks(documents: DataFrame, items: DataFrame, least_words: int = 20, one_in: int = 8, common_share: float = 0.001, common_least: int = 100) -> DataFrame:
    """``(doc_id, item_id, n_words, n_changed, score, item_words)``: one row per document and item of which it holds the whole
    text or at least ``least_words`` consecutive words, at most one word in ``one_in`` of them changed.

    ``documents``: (doc_id, text), ``items``: (item_id, text); other columns are ignored. Rows without id and null or wordless texts match nothing,
    rows of one id are searched each and give its best match, empty tables none. All documents are searched in full with all runs
    of words; only ids and 8-byte hashes of runs that are seeds leave the scan, and texts are read again for candidates only.
    A seed in more than ``common_share`` of the documents, and in more than ``common_least``, is no evidence alone: it needs a second run of ``context_length`` tokens
    within reach, on both sides (items under ``least_words`` words have no room for one, their seeds always count). The cost of a
    stock phrase thus grows with its documents, not with documents times items. Documents are never grouped, and one with very
    many candidates is split, so neither a text that makes up a third of all rows nor a page of all items is a hot key.
    """
    spark = documents.sparkSession
    out_schema = "doc_id bigint, item_id bigint, n_words int, n_changed int, score int, item_words int"
    toks = words_of_tokens(F.col("text"))
    prepared = items.where("item_id is not null").select("item_id", toks.alias("toks")).where(F.size("toks") > 0)
    prepared = prepared.select("item_id", F.transform("toks", lambda x: x["t"]).alias("item_toks"), F.transform("toks", lambda x: x["w"]).alias("item_words"))
    n_words = F.element_at("item_words", -1) + 1
    prepared = materialize(prepared.select("*", F.transform("item_toks", lambda t: F.xxhash64(t)).alias("hashes"), n_words.alias("n_words"), seed_lengths(n_words, least_words, one_in).alias("n")))
    sizes = sorted(r["n"] for r in prepared.select("n").distinct().collect())  # at most least_words different numbers
    if not sizes:
        return spark.createDataFrame([], out_schema)
    seeds = materialize(_seeds(prepared, sizes))
    known = _small(materialize(seeds.select("gram").distinct()))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null").withColumn("row", F.xxhash64("text"))
    found = texts.select("doc_id", "row", F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("hashes"))
    found = found.select("doc_id", "row", F.explode(F.array_distinct(F.concat(*[runs(F.col("hashes"), n) for n in sizes]))).alias("gram"))
    hits = materialize(found.join(known, "gram", "left_semi"))
    key = ["doc_id", "row"]
    frequent = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > F.lit(max(common_share * texts.count(), common_least))).select("gram")
    context, long_items = context_length(least_words, one_in), prepared.where(F.col("n_words") >= least_words)
    common = materialize(frequent.join(_seeds(long_items, sizes).select("gram").distinct(), "gram", "left_semi") if context >= 2 else frequent.limit(0))
    # a gram may be common and still count alone for a short item
    alone = seeds.join(common, "gram", "left_anti").unionByName(seeds.join(prepared.where(F.col("n_words") < least_words).select("item_id"), "item_id", "left_semi").join(common, "gram", "left_semi").select("item_id", "gram"))
    candidates = hits.join(alone, "gram").select(*key, "item_id")
    if not common.isEmpty():
        n = min(seed_length(k, least_words, one_in) for k in range(least_words, least_words + one_in * least_words))
        reach = 2 * least_words + (2 * least_words) // one_in + 2
        asked = long_items.join(seeds.join(common, "gram", "left_semi").groupBy("item_id").agg(F.collect_set("gram").alias("seeds")), "item_id")
        asked = materialize(asked.select("item_id", F.explode(seed_contexts(F.col("hashes"), F.col("item_words"), F.col("seeds"), n, context, reach)).alias("x")).select("item_id", "x.gram", "x.near"))
        suspects = hits.join(common, "gram", "left_semi").groupBy(*key).agg(F.collect_set("gram").alias("seeds"))  # at most the runs of one text
        again = texts.join(suspects, key).select(*key, "seeds", words_of_tokens(F.col("text")).alias("toks"))
        again = again.select(*key, "seeds", F.transform("toks", lambda x: F.xxhash64(x["t"])).alias("hashes"), F.transform("toks", lambda x: x["w"]).alias("words"))
        pairs = again.select(*key, F.explode(seed_contexts(F.col("hashes"), F.col("words"), F.col("seeds"), n, context, reach)).alias("x")).select(*key, "x.gram", "x.near")
        candidates = candidates.unionByName(pairs.join(_small(asked), ["gram", "near"]).select(*key, "item_id"))
    candidates = materialize(candidates.distinct())
    total = candidates.count()
    tasks = max(1, min(-(-total // PAIRS_PER_TASK), max(200, 8 * spark.sparkContext.defaultParallelism)))
    shares = candidates.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ITEMS_PER_SHARE).alias("shares"))
    placed = candidates.join(shares, key).withColumn("share", F.pmod(F.xxhash64("item_id"), F.col("shares"))).drop("shares")
    spread = shares.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"))
    key = [*key, "share"]
    # both sides by document into as many parts as the alignment needs: a text is shuffled once for each share, not for each of its items
    found_toks = texts.join(spread, ["doc_id", "row"]).repartition(tasks, *key).select(*key, tokens(F.col("text")).alias("doc_toks"))
    pairs = found_toks.join(placed.repartition(tasks, *key), key).join(prepared.select("item_id", "item_toks", "item_words", "n"), "item_id")
    scored = pairs.select("doc_id", "item_id", "doc_toks", "item_toks", "item_words", "n").mapInPandas(_score(least_words, one_in), out_schema)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("n_changed")).alias("kept"), "score", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", (-F.col("b.kept")).alias("n_changed"), "b.score", "b.item_words")
