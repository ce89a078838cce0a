"""Problem 8: a mixture of sources with target weights, sized in tokens.

Method: min-cost flow. Documents are aggregated by membership pattern (the set of sources they belong to: copies of one text may
lie in several); token capacity is routed from patterns to source quotas, and every further use of the same tokens costs more, so
repetition spreads evenly and overlapping sources share what they have. The flow has as many nodes as there are patterns and sources, never documents. The
documents are then selected by a seeded order.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genlex.operators.lexicon import ordinals
from genlex.session import materialize

from .lookalikes import BLANKS

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MAX_PATTERNS = 100_000  # more patterns or targets than this would be too many for one flow on the driver: then it raises
EVEN_USES = 16  # uses of the same tokens are told apart one by one up to here, and beyond it by doubling classes
_loaded: dict = {}


def source_key(c: Column) -> Column:
    """Sources compare without case and blanks around them; blank is null."""
    bare = F.lower(F.regexp_replace(c.cast("string"), f"^{BLANKS}|{BLANKS}$", ""))
    return F.when(bare != "", bare)


def _counter(path: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _loaded:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(SparkFiles.get(os.path.basename(path)))
            _loaded[path].encode_special_tokens = True  # their spelling in a text is ordinary text
        for texts in batches:
            out: list[int] = []
            values = ["" if t is None else t for t in texts]
            for k in range(0, len(values), 256):
                out += [len(e.ids) for e in _loaded[path].encode_batch_fast(values[k : k + 256], add_special_tokens=False)]
            yield pd.Series(out, dtype="int64")

    return count


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole text by a public tokenizer file, which Spark sends to every executor; null counts 0."""
    SparkSession.active().sparkContext.addFile(tokenizer)
    return F.pandas_udf(_counter(tokenizer), "bigint")(text)


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, sources, tokens)``: documents with non-blank text and a source; ``sources`` has the one source of the row."""
    readable = F.col("text").isNotNull() & (F.regexp_replace("text", BLANKS, "") != "")
    src = documents.where(readable).select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("s"), "text").where("s is not null")
    return src.select("id", F.array("s").alias("sources"), token_count(F.col("text"), tokenizer).alias("tokens"))


def shared_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, sources, tokens, copies)``: as ``sized_documents``, but rows of one text under several sources are one document of all of them.

    The n-th copy of a text in one source is one document with the n-th copies in the others (``copies`` rows, the smallest id), so
    each source keeps the tokens that its own rows have. The text is the whole text, compared by a 256-bit digest; texts are
    read once and never shuffled, and copies are numbered without a task per text: one text may fill a third of all rows.
    """
    readable = F.col("text").isNotNull() & (F.regexp_replace("text", BLANKS, "") != "")
    src = documents.where(readable).select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("s"), "text").where("s is not null")
    src = materialize(src.select("id", "s", F.sha2("text", 256).alias("same"), token_count(F.col("text"), tokenizer).alias("tokens")))
    several = src.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same")
    copied = materialize(src.join(several, "same", "left_semi"))
    nth = ordinals(copied, ["same", "s"], ["id"], "nth")
    one = nth.groupBy("same", "nth").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("s")).alias("sources"), F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))  # at most one row per source
    alone = src.join(several, "same", "left_anti").select("id", F.array("s").alias("sources"), "tokens", F.lit(1).cast("bigint").alias("copies"))
    return one.select("id", "sources", "tokens", "copies").unionByName(alone)


def _uses(most: int) -> Iterator[tuple[int, int]]:
    """(first use, number of uses) of each cost class, up to ``most`` uses: convex, and few however often text may be repeated."""
    at = 1
    while at <= most:
        width = 1 if at <= EVEN_USES else min(at - 1, most - at + 1)
        yield at, width
        at += width


def shared_flow(patterns: list[tuple[tuple[str, ...], int]], repeats: dict[str, int], quota: dict[str, int]) -> dict[tuple[int, str], int]:
    """Tokens per (pattern index, source) of a cheapest maximal flow from patterns to sources.

    A pattern's tokens may go to each of its sources ``repeats`` times over; the n-th use of the same tokens costs n - 1, whichever
    source makes it. Costs lie on the patterns only and rise with use, so the cheapest maximal flow is found class by class: the
    first use of everything is routed as far as it goes, then the second on what that left, and so on (the reachable supplies are
    a polymatroid, where greedy is exact). Each class is a maximum flow by levels of the residual graph (Dinic), whose arcs are
    the memberships.
    """
    names = list(quota)
    at = {s: k for k, s in enumerate(names)}
    out_arcs = [[at[s] for s in members if s in at] for members, _ in patterns]
    limit = [{s: tokens * repeats[names[s]] for s in arcs} for arcs, (_, tokens) in zip(out_arcs, patterns, strict=True)]
    flow: list[dict[int, int]] = [dict.fromkeys(arcs, 0) for arcs in out_arcs]
    into: list[list[int]] = [[] for _ in names]
    for k, arcs in enumerate(out_arcs):
        for s in arcs:
            into[s].append(k)
    need = [quota[n] for n in names]
    most = [sum(repeats[names[s]] for s in arcs) for arcs in out_arcs]
    supply = [0] * len(patterns)
    for first, width in _uses(max(most, default=0)):
        for k, (_, tokens) in enumerate(patterns):
            supply[k] += tokens * max(0, min(width, most[k] - first + 1))
        while any(need):
            # levels: patterns with supply are 0; a pattern leads to a source with room, a source back to patterns that it takes from
            level_p, level_s = [0 if supply[k] else -1 for k in range(len(patterns))], [-1] * len(names)
            line, reached = deque(("p", k) for k in range(len(patterns)) if supply[k]), False
            while line:
                kind, v = line.popleft()
                if kind == "p":
                    for s in out_arcs[v]:
                        if level_s[s] < 0 and flow[v][s] < limit[v][s]:
                            level_s[s] = level_p[v] + 1
                            reached = reached or need[s] > 0
                            line.append(("s", s))
                elif not need[v]:
                    for k in into[v]:
                        if level_p[k] < 0 and flow[k][v] > 0:
                            level_p[k] = level_s[v] + 1
                            line.append(("p", k))
            if not reached:
                break
            next_p, next_s = [0] * len(patterns), [0] * len(names)
            for start in range(len(patterns)):
                while supply[start] and level_p[start] == 0:
                    path, v = [], start  # arcs (pattern, source, +1 or -1)
                    while True:
                        if path and path[-1][2] > 0 and need[v]:
                            push = min([supply[start], need[v]] + [limit[p][s] - flow[p][s] if d > 0 else flow[p][s] for p, s, d in path])
                            for p, s, d in path:
                                flow[p][s] += d * push
                            supply[start] -= push
                            need[v] -= push
                            break
                        on_source = bool(path) and path[-1][2] > 0
                        if on_source:
                            step = next((j for j in range(next_s[v], len(into[v])) if level_p[into[v][j]] == level_s[v] + 1 and flow[into[v][j]][v] > 0), None)
                            next_s[v] = len(into[v]) if step is None else step
                            if step is not None:
                                path.append((into[v][step], v, -1))
                                v = into[v][step]
                                continue
                        else:
                            step = next((j for j in range(next_p[v], len(out_arcs[v])) if level_s[out_arcs[v][j]] == level_p[v] + 1 and flow[v][out_arcs[v][j]] < limit[v][out_arcs[v][j]]), None)
                            next_p[v] = len(out_arcs[v]) if step is None else step
                            if step is not None:
                                path.append((v, out_arcs[v][step], 1))
                                v = out_arcs[v][step]
                                continue
                        if not path:  # nothing leads on from the start in these levels
                            break
                        p, s, d = path.pop()
                        v = p if d > 0 else s
                        if d > 0:
                            next_p[p] += 1
                        else:
                            next_s[s] += 1
                    if not path:
                        break
        if not any(need):
            break
    return {(k, names[s]): f for k, arcs in enumerate(flow) for s, f in arcs.items() if f}


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, float, int]], total: int) -> tuple[dict[tuple[int, str], int], dict[str, int]]:
    """(tokens per pattern index and source, quota per source). ``patterns``: (sources, tokens), ``targets``: (source, weight, repeats)."""
    import math

    quota = {s: math.ceil(w * total) for s, w, _ in targets}
    repeats = {s: max(0, int(r)) for s, _, r in targets}
    return shared_flow(patterns, repeats, quota), quota


def plan_mixture(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[list[dict], list[dict]]:
    """(intervals, report) of a mixture; ``sized`` must be written data. Only counts per pattern come to the driver.

    intervals: for each pattern and source the stretch [begin, end) of the pattern's token axis, laid round a ring of its
    length, that the source uses. ``total``: tokens that the weights refer to, else those of ``sized``. report: one entry per target. A source given twice in ``targets`` keeps its larger weight.
    """
    pattern = F.array_sort(F.array_distinct("sources"))
    sums = sized.groupBy(pattern.alias("sources")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    rows = sums.orderBy("sources").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = [(tuple(r["sources"]), int(r["tokens"])) for r in rows]
    wanted = targets.groupBy(source_key(F.col("source")).alias("key")).agg(F.max(F.struct(F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("r"), F.col("source"))).alias("t"))
    named = wanted.where("key is not null").orderBy("key").limit(MAX_PATTERNS + 1).collect()
    if len(named) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} targets")
    total = sum(t for _, t in patterns) if total is None else total
    flow, quota = route(patterns, [(r["key"], r["t"]["w"], r["t"]["r"]) for r in named], total)
    intervals, begin = [], [0] * len(patterns)
    for (k, s), tokens in sorted(flow.items()):
        intervals.append({"sources": list(patterns[k][0]), "length": patterns[k][1], "source": s, "begin": begin[k], "end": begin[k] + tokens})
        begin[k] += tokens
    report = []
    for r in named:
        s = r["key"]
        routed = sum(f for (_, q), f in flow.items() if q == s)
        report.append({"key": s, "source": r["t"]["source"], "target_weight": r["t"]["w"], "max_repeats": r["t"]["r"], "quota": quota[s], "available": sum(t for m, t in patterns if s in m), "routed": routed, "met": routed >= quota[s]})
    return intervals, report


def select_documents(sized: DataFrame, intervals: list[dict], seed: int = 42, buckets: int = 4096) -> DataFrame:
    """``(id, source, repeats, tokens)``: the documents of the mixture and how often each is used (never more than allowed).

    A pattern's documents lie on its token axis in the order of a seeded hash; a source uses a document once for each time the
    document's first token falls into its interval round the ring, so the tokens taken differ from the flow by less than one
    document at either end. Places on the axis come from sums per hash bucket plus a running sum inside each bucket: no window
    ever spans a whole pattern, which may hold a third of all documents.
    """
    spark = sized.sparkSession
    schema = "sources array<string>, length bigint, source string, begin bigint, end bigint"
    plan = spark.createDataFrame([tuple(x.values()) for x in intervals], schema)
    base = sized.where("tokens > 0").select("id", F.array_sort(F.array_distinct("sources")).alias("sources"), "tokens", F.xxhash64(F.col("id"), F.lit(seed)).alias("h"))
    base = base.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = base.groupBy("sources", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("sources", "bucket", (F.sum("t").over(Window.partitionBy("sources").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("sources", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = base.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["sources", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    uses = F.expr("floor((end - 1 - at) / length) - floor((begin - 1 - at) / length)").cast("bigint")
    return placed.join(plan, "sources").select("id", "source", uses.alias("repeats"), "tokens").where("repeats > 0")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 42, shared: bool = True) -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: ``doc_id, source, repeats, tokens``; report: one row per target source with
    ``source, target_weight, max_repeats, quota, available, taken, actual_share, met``.

    quota = target_weight x tokens of all documents with non-blank text and a source. A source that cannot reach its quota is
    used max_repeats times over and has met = false. Null sources and texts take no part; rows that repeat count each; empty
    tables give an empty selection and a report without tokens. ``shared``: a text that occurs under several sources is one
    document that each of them may use (see ``shared_documents``); quotas, and which of them can be met, stay the same.
    """
    spark: SparkSession = documents.sparkSession
    sized = materialize((shared_documents if shared else sized_documents)(documents, tokenizer))
    total = sized.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0 if shared else None
    intervals, report = plan_mixture(sized, targets, total)
    chosen = select_documents(sized, intervals, seed)
    rows = spark.createDataFrame(
        [tuple(r[k] for k in ("key", "source", "target_weight", "max_repeats", "quota", "available", "met")) for r in report],
        "key string, source string, target_weight double, max_repeats int, quota bigint, available bigint, met boolean",
    )
    taken = chosen.groupBy(F.col("source").alias("key")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken"))
    every = Window.partitionBy()  # over the few rows of the report
    out = rows.join(taken, "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    all_taken = F.sum("taken").over(every)
    share = F.when(all_taken > 0, F.round(F.col("taken") / all_taken, 6))
    report_df = out.select("source", "target_weight", "max_repeats", "quota", "available", "taken", share.alias("actual_share"), "met")
    return chosen.select(F.col("id").alias("doc_id"), "source", "repeats", "tokens"), report_df
