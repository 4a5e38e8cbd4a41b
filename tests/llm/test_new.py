"""Host rules, threshold search and vector codes against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from curalis.llm import host_rules, threshold_search, vector_codes

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def _measures(t):
    t = t or ""
    w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "a a a a a", "a b c a b c x", "x y z\nx y z\n\nx y z ", "one word 　 \x85 two", "é漢🙂 #*$%&|<>" * 3, "a b c " * 40, " ".join(f"w{i}" for i in range(60_000)), "a b", "a b c", "a b c d a b"]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _host string, w string, host string, n string, kept string, doc string, score string, rank string")


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "s", *["x"] * 9) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", *["x"] * 9)]
    got = host_rules.judge(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got)[3] == 2
    for r in got:
        assert tuple(r[c] for c in host_rules.MEASURES) == _measures(TEXTS[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: _measures(r.text) for r in real.collect()}
    assert {r.doc_id: tuple(r[c] for c in host_rules.MEASURES) for r in host_rules.judge(real).collect()} == want


def _prior(hosts):
    """Beta prior of [(n, failures)], by the moments, in plain Python."""
    n, k, h = sum(a for a, _ in hosts), sum(b for _, b in hosts), len(hosts)
    if h < 2 or not 0 < k < n:
        return 0.5, 0.5
    p = k / n
    spread, free = sum(a * (b / a - p) ** 2 for a, b in hosts), n - sum(a * a for a, _ in hosts) / n - (h - 1)
    within = (spread - p * (1 - p) * (h - 1)) / (p * (1 - p) * free) if free > 0 else 0
    weight = min(max((1 - within) / within, 1e-3), 1e4) if within > 0 else 1e4
    return p * weight, (1 - p) * weight


def test_host_verdicts(spark):
    good, junk = " ".join(f"word{i}" for i in range(80)), "short text"
    rows, hosts = [], {"bad": (30, 27), "small": (1, 1), "fine": (400, 8), "other": (60, 0), None: (5, 3), "": (10, 10)}
    for h, (n, k) in hosts.items():
        rows += [(len(rows) + i, junk if i < k else good, h, *["x"] * 9) for i in range(n)]
    d = _docs(spark, rows)
    got = {r.doc_id: r for r in host_rules.judge(d).collect()}
    a, b = _prior([v for h, v in hosts.items() if h is not None])
    for i, t, h, *_ in rows:
        n, k = hosts[h]
        failed = h is not None and (k + a) / (n + a + b) > 0.5
        assert got[i].kept == (t == good and not failed), (h, got[i])
        assert got[i].host_failures == (None if h is None else "short" if failed else "")
    assert {got[i].kept for i, t, h, *_ in rows if h == "bad"} == {False} and all(got[i].kept for i, t, h, *_ in rows if h == "fine" and t == good)
    kept = host_rules.keep(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert host_rules.judge(d.limit(0)).count() == 0 and host_rules.keep(d.limit(0)).count() == 0


def test_many_hosts_meet_in_a_shuffle(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 60) as text", "concat('h', case when id % 3 = 0 then 0 else id end) as source")
    got = host_rules.judge(d)
    assert got.count() == 3000 and got.filter("host_failures is null").count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _ranked(docs, items, k=10):
    """Every score of every document, in plain Python."""
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(w for _, c in held for w in c)
    out = []
    for i, t in items:
        q, found = Counter(_terms(t)), []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // length
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, x in q.items() if w in c)
            found += [(-s, d)] if s > 0 else []
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block", [(4_000_000, 250_000), (300, 40)])
def test_search_equals_all_scores(spark, monkeypatch, shard, block):
    monkeypatch.setattr(threshold_search, "SHARD", shard)
    monkeypatch.setattr(threshold_search, "BLOCK", block)
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, threshold_search.search(docs.coalesce(1), items).collect()), key=str)
    assert got == _ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_ties_nulls_and_odd_texts(spark):
    texts = ["Blue cat", "blue CAT", None, "", "...", "cat", "É été_x déjà", "blue " * 500 + "cat", "zebra", "blue cat", "  漢字 blue"]
    docs = _docs(spark, [(i, t, None, *["x"] * 9) for i, t in enumerate(texts)] + [(9, texts[9], None, *["x"] * 9)])
    ask = [(1, "blue cat cat"), (1, "blue cat cat"), (2, None), (3, "unicorn ..."), (None, "été x"), (4, "漢字")]
    items = spark.createDataFrame(ask, "item_id int, text string")
    got = threshold_search.search(docs, items, k=4).collect()
    want = _ranked([(i, t) for i, t in enumerate(texts)] + [(9, texts[9])], list(dict.fromkeys(ask)), k=4)
    assert sorted(map(tuple, got), key=str) == want and {r.item_id for r in got} == {1, None, 4}
    assert threshold_search.search(docs.limit(0), items).count() == 0 and threshold_search.search(docs, items.limit(0)).count() == 0


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(1)
    n = 20_000
    term = np.tile(np.arange(3), n)
    impact = rng.pareto(1.0, 3 * n).__mul__(100).astype(np.int64) + 1
    s = threshold_search.Shard(np.arange(n), np.arange(0, 3 * n + 1, 3), term, impact)
    looked, plain = [], s.scores
    s.scores = lambda rows, weight: (looked.append(len(rows)), plain(rows, weight))[1]
    doc, score = s.top([(0, 1), (1, 2), (2, 1)], np.zeros(3, np.int64), 10)
    full = (impact.reshape(-1, 3) * [1, 2, 1]).sum(1)
    best = np.lexsort((np.arange(n), -full))[:10]
    assert doc.tolist() == best.tolist() and score.tolist() == full[best].tolist() and sum(looked) < n / 10


def _lloyd(rows):
    """Lloyd rounds from the start each time, in Python's own integers."""
    ok = [(i, l, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0], r[2]))
    w = len(ok[0][2]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, _, v in ok[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            mine = [near(part(v, p), books[p])[1] for _, _, v in ok]
            for k in range(len(books[p])):
                some = [part(v, p) for m, (_, _, v) in zip(mine, ok) if m == k]
                books[p][k] = [sum(c) // len(some) for c in zip(*some)] if some else books[p][k]
    found = [(i, l, [near(part(v, p), books[p]) for p in range(8)]) for i, l, v in ok]
    total = Counter()
    for _, l, x in found:
        total[l] += sum(d for d, _ in x)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), total[l], sha) for i, l, x in found)


ODD = "vec_id long, embedding array<float>, label int, part string, code string, v string, old string"


@pytest.mark.parametrize("scale, count", [(1.0, 150), (3000.0, 60), (0.01, 40), (1.0, 5)])
def test_codes_equal_lloyd_from_the_start(spark, scale, count):
    rng = np.random.default_rng(count)
    rows = [(i, (np.float32(scale) * rng.standard_normal(16).astype(np.float32)).tolist(), None if i % 5 == 0 else i % 3) for i in rng.permutation(count).tolist()]
    rows += [(900, rows[0][1], 1), (901, None, 1), (902, [None] * 16, 1), (903, [float("nan")] + [0.0] * 15, None), (904, [float("inf")] * 16, 1), (905, [], 1), (906, [0.0] * 7, 1), (907, rows[0][1], 2), (907, rows[1][1], 2)]
    d = spark.createDataFrame([(i, v, l, *["x"] * 4) for i, v, l in rows], ODD)
    want = _lloyd([r for r in rows if r[0] not in (905, 906)])
    assert sorted(map(tuple, vector_codes.compress(d).collect())) == want
    assert vector_codes.compress(d.limit(0)).count() == 0 and vector_codes.compress(d.filter("vec_id = 901")).count() == 0


def test_only_changed_parts_contribute(spark):
    state = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8] * 2, bytes([1] * 8), bytes([1] * 7 + [0])), ([9] * 16, bytes(8), bytes(8)), ([2] * 16, bytes(8), None)], "v array<int>, code binary, old binary")
    got = {(r.part, r.entry): (r.n, r.s) for r in vector_codes.changes(state, 2, 16).collect()}
    assert got == {(p, 0): (1, [2, 2]) for p in range(7)} | {(7, 0): (0, [2 - 7, 2 - 8]), (7, 1): (1, [7, 8])}
