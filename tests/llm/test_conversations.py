import random
from datetime import datetime, timedelta

from genlex.llm import conversations as C

COLS = "message_id string, parent_id string, role string, content string, created_at timestamp, ingested_at timestamp, id string, leaf string, user_id long"
T0 = datetime(2024, 1, 1)


def table(spark, rows):
    """rows: (id, parent, role, content[, minutes])"""
    full = [(r[0], r[1], r[2], r[3], T0, None if len(r) > 4 and r[4] is None else T0 + timedelta(minutes=r[4] if len(r) > 4 else k), "clash", "clash", 1) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, COLS)


def found(df):
    return sorted(set(tuple(r) for r in C.conversations(df).select("root_id", "last_id", "n_messages").collect()))


def brute(rows):
    """The definition, message by message."""
    norm = lambda x: (x or "").strip() or None
    role = lambda r: next((k for k, v in C.ROLES.items() if (r or "").strip().lower() in v), None)
    last = {}
    for k, r in enumerate(rows):
        i = norm(r[0])
        if i and (i not in last or r[4] >= last[i][4]):
            last[i] = r
    kids = {}
    for i, r in last.items():
        kids.setdefault(norm(r[1]), []).append(i)
    out = set()

    def walk(path):
        here = path[-1]
        for c in kids.get(here, []):
            walk([*path, c])
        if here not in kids:
            p = path[:-1] if role(last[here][2]) == "user" else path
            roles = [role(last[i][2]) for i in p]
            turns = roles[1:] if roles[:1] == ["system"] else roles
            if turns and len(turns) % 2 == 0 and all(t == ("user", "assistant")[k % 2] for k, t in enumerate(turns)) and all(any(ch.isalnum() for ch in last[i][3] or "") for i in p):
                out.add((p[0], p[-1], len(p)))

    for root in kids.get(None, []):
        walk([root])
    return sorted(out)


def test_rules(spark):
    rows = [
        ("r", None, "prompter", "q"), (" a ", "r", "Bot", "x"), ("b", "a ", "user", "cut"), ("c", "a", "human", "q2"), ("d", " c", "assistant", "y"),
        ("s", " ", "système", "cadre"), ("t", "s", "utilisateur", "q"), ("u", "t", "gpt", "ok"),
        ("e", "", "user", "q"), ("f", "e", "assistant", " ?! "),  # nothing readable
        ("g", "gone", "user", "q"), ("h", "g", "assistant", "x"),  # parent absent
        ("i", "", "assistant", "starts wrong"), ("j", "", "user", "alone"), ("k", None, "moderator", "m"), ("l", "k", "user", "q"), ("m", "l", "assistant", "x"),
        ("o", "p", "user", "loop"), ("p", "o", "assistant", "loop"), (None, "r", "assistant", "no id"), ("  ", None, "user", "no id"), ("n", None, "user", None), ("n2", "n", "assistant", "x"),
    ]
    assert found(table(spark, rows)) == [("r", "a", 2), ("r", "d", 4), ("s", "u", 3)]


def test_versions(spark):
    rows = [("r", None, "user", "q", 1), ("a", "r", "assistant", "", 5), ("a", "r", "assistant", "good", 9), ("a", "r", "assistant", "bad?", None), ("r", None, "user", "q", 1)]
    assert found(table(spark, rows)) == [("r", "a", 2)]
    assert found(table(spark, [*rows, ("a", "r", "assistant", "...", 10)])) == []


def test_empty_and_long_thread(spark):
    assert found(table(spark, [])) == []
    chain = [(f"m{k}", f"m{k - 1}" if k else None, ("user", "assistant")[k % 2], "x") for k in range(300)]
    random.Random(1).shuffle(chain)
    assert found(table(spark, chain)) == [("m0", "m299", 300)]


def test_huge_threads_are_chained_with_equal_results(spark):
    star = [("r", None, "user", "q")] + [(f"a{k}", "r", "assistant", "x" * 10) for k in range(700)] + [("z", None, "user", "q"), ("y", "z", "assistant", "x"), ("w", "a3", "user", "cut"), ("v", "a4", "user", "..."), ("u", "v", "assistant", "x")]
    df = table(spark, star)
    by_state = sorted(tuple(r) for r in C.conversations(df, with_path=True).collect())
    chained = sorted(tuple(r) for r in C.conversations(df, with_path=True, split_above=100).collect())
    assert by_state == chained and len(chained) == 700
    assert ("r", "a3", 2, "w", ["r", "a3"]) in chained and ("z", "y", 2, "y", ["z", "y"]) in chained


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        parent = None if rng.random() < 0.15 else f"m{rng.randrange(max(1, k + 5))}"
        rows.append((f"m{k}", parent, rng.choice(["user", "assistant", "assistant", "human", "system", "?"]), rng.choice(["ok", "ok", "ok", "ok", "..."]), k))
    rows += [(r[0], r[1], r[2], "new", r[4] + 1000) for r in rng.sample(rows, 60)]
    df = table(spark, rows)
    assert found(df) == brute(rows)
    assert sorted(tuple(r)[:3] for r in C.conversations(df, split_above=0).collect()) == brute(rows)


def event(thread, id_, parent, who, day, version=None):
    return (0, thread, id_, parent, who, True, version if version is not None else day, T0 + timedelta(days=day))


def folder(spark, path, *files):
    """One parquet file for each list of events, aged in this order."""
    import glob
    import os

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, C.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for f in glob.glob(f"{path}/*.parquet"):
            if os.path.getmtime(f) > 1_000_000_000 + len(files):
                os.utime(f, (1_000_000_000 + k,) * 2)
    return path


def test_timeout_and_closure_fire_behind_a_bounded_delay(spark, tmp_path):
    """Conversations are emitted while the stream still runs: a closed one after ``quiet``, one that waits for a reply after ``wait``."""
    files = [
        [event("r", "r", None, "u", 0), event("r", "a", "r", "a", 0), event("s", "s", None, "u", 0), event("s", "b", "s", "a", 0), event("s", "c", "b", "u", 0), event("x", "y", "x", "a", 0)],
        [event("t", "t", None, "u", 10)], [event("t", "d", "t", "a", 11)], [event("q", "q", None, "u", 60)], [event("q", "e", "q", "a", 61)],
    ]
    path = folder(spark, str(tmp_path / "ev"), *files)
    out, late = C._stream(spark, path, 1, delay="1 day", keep_ms=None)
    got = sorted((r["thread"], r["root_id"], r["last_id"], r["n_messages"]) for r in out.collect())
    assert not late and got == [("r", "r", "a", 2), ("s", "s", "b", 2), ("t", "t", "d", 2)]  # q still waits for the watermark


def test_a_late_row_opens_the_thread_again(spark, tmp_path):
    files = [[event("r", "r", None, "u", 0), event("r", "a", "r", "a", 0)], [event("o", "o", None, "u", 20)], [event("r", "b", "a", "u", 21), event("r", "c", "b", "a", 21)], [event("o", "p", "o", "a", 40)], [event("r", "c", "b", "s", 80, version=90)]]
    path = folder(spark, str(tmp_path / "ev"), *files)
    every, late = C._stream(spark, path, 1, keep_ms=None)
    got = [tuple(r) for r in every.select("root_id", "last_id", "n_messages").where("thread = 'r'").collect()]
    assert not late and ("r", "a", 2) in got and ("r", "c", 4) in got  # first revision, second revision
    last = C.replay(spark, path, files_per_trigger=1).select("root_id", "last_id", "n_messages").collect()
    assert [tuple(r) for r in last] == [("o", "p", 2)]  # the third takes it back: the last speaker is no assistant any more


def test_rows_behind_the_watermark_are_not_lost(spark, tmp_path):
    """Files newest first: the second falls behind the watermark, Spark counts its rows, and the replay covers them."""
    path = folder(spark, str(tmp_path / "ev"), [event("r", "a", "r", "a", 900)], [event("s", "s", None, "u", 500)], [event("r", "r", None, "u", 1), event("s", "b", "s", "a", 2)])
    assert C._stream(spark, path, 1, keep_ms=None)[1]
    assert sorted(r["last_id"] for r in C.replay(spark, path, files_per_trigger=1).collect()) == ["a", "b"]
    assert sorted(r["last_id"] for r in C.replay(spark, path).collect()) == ["a", "b"]


def test_state_is_let_go_after_the_keeping_time(spark, tmp_path):
    path = folder(spark, str(tmp_path / "ev"), [event("r", "r", None, "u", 0), event("r", "a", "r", "a", 0)], [event("o", "o", None, "u", 200)], [event("o", "p", "o", "u", 201)], [event("r", "b", "a", "u", 202), event("r", "c", "b", "a", 202)], [event("o", "z", "o", "u", 900)])
    out, _ = C._stream(spark, path, 1, keep_ms=60 * C.DAY)
    assert [(r["root_id"], r["last_id"]) for r in out.collect()] == [("r", "a")]


def test_transcripts(spark):
    rows = [("r", None, "prompter", "q"), ("a", "r", "bot", "x"), ("b", "a", "user", "cut"), ("c", "a", "user", "cut too")]
    got = sorted(tuple(r) for r in C.transcripts(table(spark, rows)).collect())
    assert got == [("r", "a", 0, "r", "user", "q"), ("r", "a", 1, "a", "assistant", "x")]
