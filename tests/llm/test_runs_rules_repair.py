"""Periodic runs, url rules and conversation repair against brute force, and on nulls, ties, empty tables and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import conversations, queries, runs, url_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least):
    """Every period, every stretch that agrees with itself that far on, its least period only."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(all(w[t] == w[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_many_texts_that_share_a_grammar():
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, v = rng.randint(0, rng.choice([14, 60, 150])), rng.choice([1, 2, 3, 5, 50])
            w = [str(rng.randrange(v)) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        texts += texts[:2]
        least = rng.choice([2, 5, 12])
        assert runs.runs_of(texts, least) == [brute_runs(w, least) for w in texts]


def test_runs_of_thue_morse_and_of_long_texts():
    morse = [str(bin(i).count("1") % 2) for i in range(1 << 12)]
    assert runs.runs_of([morse], 2) == [brute_runs(morse, 2)]
    rng = random.Random(2)
    once = [str(rng.randrange(10_000)) for _ in range(700)]
    assert runs.runs_of([once * 60 + once[:9]], 12) == [[(0, 700 * 60 + 9, 700)]]
    assert runs.runs_of([["a"] * 50_000, ["b"] * 11, []], 12) == [[(0, 50_000, 1)], [], []]


def test_the_grammar_spells_the_texts_and_replaces_repeated_pairs():
    rng = random.Random(3)
    words = np.array([rng.randrange(4) for _ in range(3000)])
    text = np.sort(np.array([rng.randrange(20) for _ in range(3000)]))
    text = np.unique(text, return_inverse=True)[1]
    g = runs.build_grammar(words, text)

    def spell(s):
        return [s] if s < g.terminals else spell(g.left[s - g.terminals]) + spell(g.right[s - g.terminals])

    assert [w for r in g.roots for w in spell(r)] == words.tolist()
    for s in range(len(g.length)):
        assert spell(s) == words[g.first[s] : g.first[s] + g.length[s]].tolist()
    assert len(set(zip(g.left.tolist(), g.right.tolist()))) < 1500  # far fewer rules than a tree for each text holds


def brute_op11(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " \n\t"[i % 3].join(rng.choice(["é", "b", "c,d", "\x1c", "x\xa0y"]) for _ in range(rng.randint(0, 90)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, "a b " * 9), (7, rows[7][1]), (903, "z " * 4000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_op11(i, t) for i, t in rows), key=str)
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or h == "" or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_url_rules_against_every_rule(spark, parts):
    rng = random.Random(7)
    hosts = ["net", "a.net", "b.a.net", "xa.net", "org", "é.org", "b.org.", "", "NET", "a..net", "com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b", "/a?b"]
    rules = list({(rng.choice(hosts[:7]), rng.choice(paths[:6])): None for _ in range(20)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [("net", "/a/b/c", "block"), ("net", "/a/b/c", "allow"), (None, "/", "block"), ("org", None, "block")]
    urls = [f"{s}{h}{p}{e}" for s in ("http://", "://", "http:") for h in hosts for p in paths for e in ("", "/b/c", "?q=/a", "#://net/")] + [None, "", "://", "x://net", "http://a.net/a/b" + "/c" * 5000, "http://" + "a." * 3000 + "net/a", "http://a.net\n/a"]
    urls += ["http://b.a.net/a/b/x"] * 300
    frame = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/a")], "page_id long, url string").withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = url_rules.judge_urls(frame, table, "allow")
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        rows = {r.page_id: tuple(r)[2:] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    known = [("net", "/a/b/c", "block") if r[:2] == ("net", "/a/b/c") else r for r in rules if None not in r]
    assert rows == {**{i: brute_judge(u, known) for i, u in enumerate(urls)}, None: brute_judge("http://a.net/a", known)}


def test_url_rules_on_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("", "", "block")], "host string, path string, verdict string")
    assert url_rules.judge_urls(none, rules).count() == 0
    assert [tuple(r)[2:] for r in url_rules.judge_urls(some, rules.limit(0)).orderBy("page_id").collect()] == [("a.net", "/x", None, "allow"), ("", "", None, "allow")]
    assert [r.verdict for r in url_rules.judge_urls(some, rules).collect()] == ["block", "block"]


def test_the_sweep_cuts_a_common_key_and_opens_its_rules_again(spark):
    points = spark.range(4000).select(F.when(F.col("id") < 3000, "net?/a/b").otherwise(F.concat(F.lit("net?/z"), F.col("id").cast("string"))).alias("key"), F.col("id").cast("string").alias("site"))
    rules = spark.createDataFrame([("net?/", "1"), ("net?/a", "2"), ("net?/z39", "3"), ("org?", "4")], "key string, rule string")
    got = {r.site: r.rule for r in url_rules.sweep_join(points, rules, 16).collect()}
    assert got == {str(i): "2" if i < 3000 else "3" if str(i).startswith("39") else "1" for i in range(4000)}


def brute_repair(turns):
    """All edits of all turns, cheapest first, by a search over (place, state) without spans."""
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(conversations.BLANKS)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "", [])}

    def grow(best):
        for _ in range(4):
            for q, (c, a, out) in list(best.items()):
                made = "assistant" if q == 2 else "user"
                way = c + 2, a + "I", [*out, f"{made}:"]
                to = step[q, made[0]]
                best[to] = min(best.get(to, way), way)
        return best

    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for q, (c, a, out) in grow(best).items():
            ways = [(q, (c + 3, a + "D", out))]
            if kind not in ("blank", "duplicate"):
                more = kind == "truncated"
                if (q, role[:1]) in step:
                    ways.append((step[q, role[:1]], (c + more, a + "K", [*out, f"{role}:{text}"])))
                made = "assistant" if q == 2 else "user"
                ways.append((step[q, made[0]], (c + 2 + more, a + "R", [*out, f"{made}:{text}"])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    cost, audit, out = min(v for q, v in grow(best).items() if q in (0, 3))
    heads = [r[1][:1] or " " for r in rows]
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_conversation(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", " ", "ua"], ["Fine.", "Fine", "no!", "", " \t", "\xa0", "Why?\n", "so: é", "user:x\ny."]
    flow = [(i, ("user", "assistant")[i % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.") for i in range(n)]
    return [(t if rng.random() < 0.9 else rng.choice([None, 0, t + 3]), r, x) for t, r, x in flow]


def test_repair_against_a_search_over_turns(spark):
    rng = random.Random(11)
    held = {i: random_conversation(rng, rng.randint(1, 14)) for i in range(150)} | {None: random_conversation(rng, 6), 200: random_conversation(rng, 900)}
    rows = [(c, *t, "x") for c, turns in held.items() for t in turns] + [(777, 3, "user", None, "x"), (5, 1, "user", None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(5)
    want = {c: brute_repair(t) for c, t in held.items()} | {777: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    for most in (4096, 3):  # the second way takes every longer conversation in blocks
        got = conversations.repair_conversations(frame, whole_turns=most)
        assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    small = conversations.repair_conversations(frame, whole_bytes=40)
    assert {r.conv_id: tuple(r)[1:] for r in small.collect()} == want
    assert conversations.repair_conversations(frame.limit(0)).count() == 0


def test_long_conversations_in_many_blocks(spark, monkeypatch):
    rng = random.Random(13)
    turns = random_conversation(rng, 5000) + [(17, "user", "Again.")] * 3000
    frame = spark.createDataFrame([("c", *t) for t in turns], "conv_id string, turn long, role string, text string")
    monkeypatch.setattr(conversations, "BLOCK_TURNS", 37)
    assert tuple(conversations.repair_conversations(frame).first())[1:] == brute_repair(turns)


def test_cells_of_spans_do_not_depend_on_where_they_are_split():
    rng = random.Random(17)
    for _ in range(50):
        kinds = [rng.choice("suaoSUAOd") for _ in range(rng.randint(1, 12))]
        cell = conversations.Spans().cell([(k, 1) for k in kinds])
        cut = rng.randint(0, len(kinds))
        halves = [conversations.Spans().cell([(k, 1) for k in part]) for part in (kinds[:cut], kinds[cut:])]
        assert conversations.joined(*halves) == cell
        assert conversations.Spans().cell([("d", 6), *((k, 1) for k in kinds)]) == conversations.Spans().cell([(k, 1) for k in ["d"] * 6 + kinds])


def test_op13_damages_nulls_and_ties(spark, tmp_path):
    rng = random.Random(19)
    rows = [(rng.choice([*range(20), None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", "system", None]), rng.choice(["A.", "b", "", None, "c?"])) for _ in range(260)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    held = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", " " if text is None else text) if h == 2 else " " if text is None else text
        role = "user" if h == 4 else " " if role is None else role
        held[c] += [(t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = queries.op13_conversations(spark, str(tmp_path)).collect()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: brute_repair(t) if t else empty for c, t in held.items()} and len(got) == len(held)
