"""Each operator against brute force on small tables, with nulls, empties, repeats and clashing extra columns."""

import hashlib
import itertools
import json
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from curalis.llm import decontaminate, language_id, line_dedup, media, minhash_dedup, packing, quality, sentence_dedup, token_counts, tool_calls
from curalis.llm._graph import components
from curalis.llm._tokens import encoder

DATA = "/root/testdata/sf0.001"
EXTRA = ["_ord", "h", "id", "part", "hs", "_w", "_m", "_b", "_c", "_p", "_doc", "n_removed", "score", "lang_pred"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + "."
    texts = [None, "", "   ", "one two three four five six seven eight", "one two three four five six seven eight", "\n\n", "é" * 3000, long, long + " more"]
    return spark.createDataFrame([(None if i == 4 else i, t, "en", None if i % 2 else "s", len(t or ""), *EXTRA) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, *EXTRA)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ids_equal_the_tokenizers_file(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "a  b", " a b ", "x\n y\t z", "don't 's <|endoftext|> 12 é漢字　z", "a b c", "a   b"]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder().encode(x), "<u2").tolist() == e.ids


def _check_pieces(rows, docs):
    enc = encoder()
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    short = [k for k, v in seq.items() if sum(n for _, n in v) < 2048]
    assert len(short) <= 1 and sorted(seq) == list(range(len(seq)))
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for d in docs:
        ids = np.append(np.frombuffer(enc.encode(d.text), "<u2"), 1).astype("<u4")
        want.setdefault((d.doc_id, len(ids)), []).append(ids)
    assert {k: sum(map(len, v)) for k, v in want.items()} == {k: sum(r.length for r in v) for k, v in by.items()}
    for k, v in by.items():
        for r in v:
            assert any(zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in want[k])


def test_packing_is_whole(docs, odd, none):
    for d in (docs, odd):
        _check_pieces(packing.pack(d, sequences_per_window=4).collect(), d.collect())
    assert packing.pack(none).count() == 0


def _rounds(totals, weight, window):
    """Tokens that each queue sends in each window, by counters that are carried from window to window."""
    left, owed, out, dry = list(totals), [Fraction(0)] * len(totals), [], False
    while sum(left):
        active = [w if n else 0 for w, n in zip(weight, left)]
        if dry:
            owed, dry = [Fraction(0)] * len(left), False
        run, served, sent, now = Fraction(0), 0, [], list(owed)
        for k, w in enumerate(active):
            run += Fraction(window * w, sum(active)) + owed[k]
            n = math.floor(run + Fraction(1, 2)) - served
            served += n
            sent.append(n)
            now[k] += Fraction(window * w, sum(active)) - n
        assert all(abs(x) < 1 for x in now)
        owed = now
        if any(n > m for n, m in zip(sent, left)):  # a queue runs dry: its grant is dealt to the others by weight, and new counters begin
            sent, dry = [0] * len(left), True
            while (room := min(window, sum(left)) - sum(sent)) > 0:
                more = [w if n > m else 0 for w, n, m in zip(weight, left, sent)]
                run, served = Fraction(0), 0
                for k, w in enumerate(more):
                    run += Fraction(room * w, sum(more))
                    n = math.floor(run + Fraction(1, 2)) - served
                    served += n
                    sent[k] += min(n, left[k] - sent[k])
        out.append(sent)
        left = [n - m for n, m in zip(left, sent)]
    return out


@pytest.mark.parametrize("totals,target", [([370, 110, 600], None), ([370, 110, 600], [5, 1, 1]), ([37, 11, 900], [1, 50, 3]), ([5, 0, 3], None), ([1000], None), ([64, 64, 64, 64, 3], None)])
def test_schedule_is_the_round_robin_with_carried_deficits(totals, target):
    n, window = np.array(totals), 64
    w = packing.weights(n, target, window)
    s = packing.Schedule(n, w, window)
    want = _rounds(totals, w.tolist(), window)
    before = [0] * len(totals)
    for j, sent in enumerate(want):
        q = np.arange(len(totals))
        a, b, slab = s.slabs(q, np.full(len(totals), j))
        assert a.tolist() == before and (b - a).tolist() == sent and slab.tolist() == np.cumsum([0, *sent[:-1]]).tolist()
        for k, m in enumerate(sent):
            assert (s.window_of(np.full(m, k), np.arange(before[k], before[k] + m)) == j).all()
        before = [x + y for x, y in zip(before, sent)]
    assert before == totals


def test_schedule_of_many_tokens_stays_exact():
    n = np.array([1 << 55, 3 << 53, 7])
    s = packing.Schedule(n, packing.weights(n, None, 131072), 131072)
    i = np.array([0, (1 << 54) + 12345, (1 << 55) - 1])
    j = s.window_of(np.zeros(3, np.int64), i)
    a, b, _ = s.slabs(np.zeros(3, np.int64), j)
    assert (a <= i).all() and (i < b).all()


def test_many_sources_share_the_last_queue(docs):
    _check_pieces(packing.pack(docs, sequences_per_window=4, most_queues=3).collect(), docs.collect())


def test_windows_hold_the_target(docs):
    rows = packing.pack(docs, length=256, sequences_per_window=8).toPandas()
    last = rows.window.max() - 1  # queues run dry in the last two
    share = rows[rows.window < last].groupby(["window", "source"]).length.sum().unstack().fillna(0)
    assert (share.max() - share.min() <= 3).all()


def test_histogram(docs, odd, none):
    for d in (docs, odd):
        lens = sorted(len(encoder().encode(r.text)) // 2 for r in d.select("text").collect())
        h = token_counts.length_histogram(d)
        for r in h.collect():
            assert r.documents == lens.count(r.length) and r.documents_from == sum(x >= r.length for x in lens) and r.documents_to == sum(x <= r.length for x in lens)
            assert r.tokens_kept == sum(min(x, r.length) for x in lens) and r.tokens_cut == sum(lens) - r.tokens_kept
        for r in token_counts.at_limits(h, [0, 7, 100, 10**9]).collect():
            assert r.tokens_kept == sum(min(x, r.limit) for x in lens) and r.documents_cut == sum(x > r.limit for x in lens)
        q = {r.share: r.length for r in token_counts.quantiles(h, [0.5, 1.0]).collect()}
        assert q[1.0] == lens[-1] and sum(x <= q[0.5] for x in lens) * 2 >= len(lens)
    assert token_counts.length_histogram(none).count() == 0


def test_media_round_trip():
    for text in [None, "", "a", "é" * 500, "x" * 896, "y" * 897, "long " * 20_000]:
        n, p = media.padded(text)
        m = media.store(p)
        s = media.parse(m)
        assert media.payload(m, s) == p and len(p) % 64 == 0 and p[:n] == (text or "").encode()
        assert s.crc_bad == 0 and s.crc_checked == len(s.offsets) + 1 and s.skipped == 0 and s.vbr["frames"] == len(s.offsets)
        assert s.duration == (1152 * len(s.offsets), 48000) and s.seek(s.samples - 1) == s.offsets[-1]


def test_media_resynchronises():
    m = media.store(b"q" * 64 * 60)
    s = media.parse(m)
    cut = m[: s.offsets[2]] + b"\xff\xfbjunk\xff\x00" + m[s.offsets[2] :]
    t = media.parse(cut)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 8 and t.crc_bad == 0
    bad = bytearray(m)
    bad[s.offsets[1] + 8] ^= 1
    assert media.parse(bytes(bad)).crc_bad == 1
    assert media.parse(b"").offsets == [] and media.parse(b"\xff" * 50).offsets == []


def test_media_table(spark, docs, odd, none):
    for d in (docs, odd):
        got, rows = media.digests(media.encode_texts(d)).collect(), d.collect()
        assert len(got) == len(rows)
        want = sorted((str(r.doc_id), len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in rows for x in [(r.text or "").encode()] for p in [x.ljust(max(64, -(-len(x) // 64) * 64), b"\0")])
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        stored = {r.doc_id: bytes(r.media) for r in media.encode_texts(d).collect()}
        assert all(hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 and len(stored[r.doc_id]) == r.media_bytes for r in got)
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1
    x = media.index_streams(media.encode_texts(odd).withColumn("frames", media.F.lit("mine"))).collect()
    assert all(r.crc_bad == 0 and r.frames == "mine" and r.frames_ == len(r.seek) for r in x)
    assert media.encode_texts(none).count() == 0


def _bits(*parts):
    out = "".join(format(v, f"0{n}b") for v, n in parts)
    return bytes(int(out[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(out), 8)), len(out)


def _crc_of(data, n):
    c = 0xFFFF
    for i in range(n):
        top = c >> 15 ^ (data[i // 8] >> 7 - i % 8 & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@pytest.mark.parametrize("layer,kbps_index,mode", [(1, 4, 0xC0), (1, 8, 0x00), (1, 8, 0x50), (2, 8, 0xC0), (2, 10, 0x00), (2, 10, 0x60), (2, 1, 0xC0)])
def test_checksums_of_layers_one_and_two(layer, kbps_index, mode):
    head = bytes((0xFF, 0xF8 | (4 - layer) << 1, kbps_index << 4 | 1 << 2, mode))
    h = media.header(head)
    both = lambda k: h.channels if k < h.bound else 1
    if layer == 1:
        side = [(k % 15, 4) for k in range(32) for _ in range(both(k))]
    else:
        value = [(k + c) % 3 for k in range(len(media._allocation(h))) for c in range(both(k))]
        side = [(v, b) for v, b in zip(value, [b for k, b in enumerate(media._allocation(h)) for _ in range(both(k))])]
        side += [(1, 2) for v, k in zip(value, [k for k in range(len(media._allocation(h))) for _ in range(both(k))]) if v for _ in range(h.channels // both(k))]
    body, n = _bits(*side)
    covered = head[2:] + body
    frame = (head + _crc_of(covered, 16 + n).to_bytes(2, "big") + body).ljust(h.size, b"\0")
    s = media.parse(frame * 3)
    assert (len(s.offsets), s.crc_checked, s.crc_bad) == (3, 3, 0)
    broken = bytearray(frame * 3)
    broken[h.size + 7] ^= 64
    assert media.parse(bytes(broken)).crc_bad == 1


def test_tags_of_all_versions():
    text = lambda x: b"\0" + x
    audio = media.store(b"q" * 64)
    audio = audio[10 + media._syncsafe(audio[6:10]) : -128]
    size = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    two = b"TT2" + (4).to_bytes(3, "big") + text(b"two")
    three = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0" + text(b"\xffx")
    un = three.replace(b"\xff", b"\xff\0")
    ext = (6).to_bytes(4, "big") + bytes(6)
    four = b"TIT2" + size(5) + b"\0\0" + b"\3four"
    got = {}
    for major, flags, body in ((2, 0, two), (3, 128, un), (3, 64, ext + three), (4, 0, four)):
        s = media.parse(b"ID3" + bytes((major, 0, flags)) + size(len(body)) + body + audio + b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(92, b"\0") + b"\0\7\0")
        assert len(s.offsets) == 1 and s.skipped == 0
        got[major, flags] = s.tags
    assert got[2, 0]["TT2"] == "two" and got[3, 128]["TIT2"] == "\xffx" == got[3, 64]["TIT2"] and got[4, 0]["TIT2"] == "four"
    assert got[2, 0]["ID3v1"] == "title" and got[2, 0]["ID3v1:artist"] == "artist" and got[2, 0]["ID3v1:track"] == "7"


def test_bitrate_table_with_entries():
    frame = bytearray(media._frame(128, b""))
    frame[36:40] = b"VBRI"
    frame[46:62] = (4000).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\0\2\0\4\0\2\0\1"
    frame[62:66] = b"\0\3\0\5"
    v = media.parse(bytes(frame) + media._frame(64, b"") * 2).vbr
    assert v == {"kind": "VBRI", "bytes": 4000, "frames": 2, "frames_an_entry": 1, "toc": [12, 20]}


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    want = _components(range(500), links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and set(got) >= {x for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("width,words", [(2, "ascii")])
def test_near_duplicates_equal_brute_force(docs, width, words):
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(minhash_dedup.shingle_set(r.text, width, words).tolist()) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    got = minhash_dedup.near_duplicates(docs, width, words).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd(odd, none):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(odd, 2, "ascii").collect()}
    assert got[0].component_id == 0 and got[1].component_id == 1 and got[2].n_shingles == 0 and got[8].component_id == 7
    assert got[None].component_id is None and got[None].kept
    assert minhash_dedup.near_duplicates(none).count() == 0
    k = minhash_dedup.keep_one(odd)
    assert k.count() == odd.count() - 1 and k.columns == odd.columns and all(r[c] == c for r in k.collect() for c in EXTRA)


def test_outlying_leader_loses_no_link(spark):
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base[:100] + [f"x{k}" for k in range(100)])] + [" ".join(base[: 200 - j] + [f"z{j}_{k}" for k in range(j)]) for j in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: set(minhash_dedup.shingle_set(t, 2, "ascii").tolist()) for i, t in enumerate(texts)}
    want = _components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(d, 2, "ascii").collect()} == want


def _distance(x, y, most):
    """Edit distance of two lists, or most + 1 where it is more."""
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        lo, hi = max(1, i - most), min(len(y), i + most)
        new = [most + 1] * (len(y) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != y[j - 1]))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _near_lines(docs):
    """Occurrences (order, line) and all pairs of different lines at edit similarity 0.8, by the edit distance alone."""
    occ, words = [], {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text:
            _, w, heads = line_dedup.lines_of(r.text)
            ends = np.append(heads, len(w))
            for k, x in enumerate(line_dedup.runs(w, heads).tolist()):
                occ.append((r.doc_id, x))
                words[x] = w[ends[k] : ends[k + 1]].tolist()
    ids = sorted(words, key=lambda x: len(words[x]))
    bags = [Counter(words[x]) for x in ids]
    links = []
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            m = len(words[ids[b]])
            if 5 * (m - len(words[ids[a]])) > m:
                break
            if m - sum((bags[a] & bags[b]).values()) <= m // 5 and _distance(words[ids[a]], words[ids[b]], m // 5) <= m // 5:
                links.append((ids[a], ids[b]))
    return occ, words, links


def test_line_dedup_equals_brute_force(docs, odd, none):
    occ, words, links = _near_lines(docs)
    comp = _components(words, links)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keep = {}
    for i, x in occ:
        keep[comp[x]] = min(keep.get(comp[x], (i, signed(x))), (i, signed(x)))
    gone, seen = {}, set()
    for i, x in occ:
        gone[i] = gone.get(i, 0) + ((i, signed(x)) != keep[comp[x]] or (i, x) in seen)
        seen.add((i, x))
    got = {r.doc_id: r.n_removed for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert set(got) == {r.doc_id for r in docs.collect()}
    assert all(n <= gone.get(i, 0) for i, n in got.items()) and sum(got.values()) >= 0.98 * sum(gone.values())
    assert line_dedup.drop_repeated_lines(none).count() == 0
    o = line_dedup.drop_repeated_lines(odd)
    assert o.count() == odd.count() and o.columns == odd.columns + ["n_removed_"]
    assert all(r[c] == c for r in o.collect() for c in EXTRA)


@pytest.mark.parametrize("n,edits", [(5, 1), (10, 1), (10, 2), (20, 1), (20, 4), (50, 1), (50, 5), (50, 10), (200, 1), (200, 40)])
def test_blocks_catch_nine_of_ten_pairs_at_the_threshold(n, edits):
    rng = np.random.default_rng(n + edits)
    hit = 0
    for _ in range(200):
        a = rng.integers(1, 1 << 63, n).astype(np.uint64)
        b = a.copy()
        b[rng.choice(n, edits, replace=False)] += np.uint64(1)
        x, y = (set(line_dedup.blocks(v, np.array([0]))[1].tolist()) for v in (a, b))
        hit += bool(x & y)
    assert hit >= (180 if n > 14 else 196 if n > 9 else 200)


def test_sentence_spans_equal_brute_force(docs, odd, none):
    owner, info, texts = {}, {}, {r.doc_id: r.text for r in docs.collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        _, w, heads, _ = sentence_dedup.sentences(r.text)
        info[r.doc_id] = len(heads), sentence_dedup.spans(w, heads).tolist()
        for x in info[r.doc_id][1]:
            owner.setdefault(x, r.doc_id)
    for r in sentence_dedup.drop_repeated_sentences(docs).collect():
        n, h = info[r.doc_id]
        drop, seen = set(), set()
        for k, x in enumerate(h):
            if owner[x] != r.doc_id or x in seen:
                drop |= set(range(k, min(n, k + sentence_dedup.SPAN)))
            seen.add(x)
        assert r.n_removed == len(drop)
        _, w, heads, _ = sentence_dedup.sentences(texts[r.doc_id])
        ends = np.append(heads, len(w))
        left = [x for k in range(n) if k not in drop for x in w[ends[k] : ends[k + 1]].tolist()]
        assert [x for x in sentence_dedup.sentences(r.text)[1].tolist() if x] == [x for x in left if x]
    assert sentence_dedup.drop_repeated_sentences(none).count() == 0
    o = sentence_dedup.drop_repeated_sentences(odd)
    assert o.count() == odd.count() and o.columns == odd.columns + ["n_removed_"] and all(r[c] == c for r in o.collect() for c in EXTRA)


def test_short_texts_are_one_span(spark):
    two = "This first sentence has a good number of words in it and does not end before the twenty fourth of them is said aloud. This second sentence too goes on for so long that it has four and twenty words when at last it comes to its end."
    d = spark.createDataFrame([(1, two), (2, two), (3, "Yes."), (4, "yes"), (5, "No.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sentence_dedup.drop_repeated_sentences(d).collect()} == {1: two, 2: "", 3: "Yes.", 4: "", 5: "No."}


def test_passage_goes_and_the_rest_stays(spark):
    p = "The old harbour lies behind the hill. Boats leave it before the sun is up! Nobody knows who built the long wall there."
    d = spark.createDataFrame([(1, f"First words stand here. {p} End of one."), (2, f"Other words begin this.\nAnd {p}\nLast line."), (3, "Nothing repeats in here at all.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_dedup.drop_repeated_sentences(d.unionByName(spark.createDataFrame([(4, p)], "doc_id long, text string"))).collect()}
    assert p in got[1] and got[4] == "" and got[3].startswith("Nothing")


def test_contained_equals_brute_force(spark, docs, odd, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, "two three"), (-2, None), (-3, "")], "item_id long, text string"))
    items = [(r.item_id, decontaminate.plain_hashes(r.text)) for r in bench.collect()]
    for d in (docs, odd):
        want = []
        for r in d.collect():
            w = decontaminate.plain_hashes(r.text)
            for i, x in items:
                k = min(5, len(x))
                if k and len(w) >= k:
                    s, own = set(decontaminate.shingles(x, k).tolist()), set(decontaminate.shingles(w, k).tolist())
                    if 100 * len(s & own) >= 80 * len(s):
                        want.append((r.doc_id, i, len(s & own)))
        key = lambda x: tuple(-99 if y is None else y for y in x)
        assert sorted(((r.doc_id, r.item_id, r.shared) for r in decontaminate.contained(d, bench).collect()), key=key) == sorted(want, key=key)
        hit = {i for i, _, _ in want}
        assert decontaminate.clean(d, bench).count() == sum(r.doc_id not in hit for r in d.collect())
    assert decontaminate.contained(none, bench).count() == 0 and decontaminate.contained(docs, bench.limit(0)).count() == 0


def test_language(docs, odd, none):
    langs, lp = language_id.fit(docs.filter(language_id.fold(docs, 3) != 1))
    got = language_id.identify(docs.filter(language_id.fold(docs, 3) == 1), langs, lp).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    o = language_id.identify(odd, langs, lp).collect()
    assert len(o) == odd.count() and all(r.lang_pred_ == "und" for r in o if not (r.text or "").strip()) and all(r[c] == c for r in o for c in EXTRA)
    assert language_id.fit(none)[0] == [] and language_id.identify(odd, [], lp[:, :0]).first().lang_pred_ == "und"
    no = docs.sparkSession.createDataFrame([(x,) for x in ("½", "²", "Ⅷ 12 ⅷ", "...")], "text string")
    assert all(r.lang_pred == "und" and r.score == 0 and r.fit is None for r in language_id.identify(no, langs, lp).collect())
    far = docs.sparkSession.createDataFrame([("漢字仮名交じり文",)], "text string")
    assert language_id.identify(far, langs, lp).first().fit < -7 < min(r.fit for r in got)


def test_forward_sums_all_segmentations():
    lat = language_id._lattice()
    rng = np.random.default_rng(1)
    lp = np.log(rng.dirichlet(np.ones(lat.size), 2).T + 1e-12)
    words = ["▁the", "▁hé漢x", "▁a", "▁running"]
    got = language_id.word_scores(lat, words, lp)
    for x, g in zip(words, got):
        w, i, j, p, _ = lat.edges([x])
        by = {}
        for a, b, q in zip(i, j, p):
            by.setdefault(int(a), []).append((int(b), int(q)))

        def total(at, k):
            return 1.0 if at == len(x) else sum((language_id.UNKNOWN if q < 0 else np.exp(lp[q, k])) * total(b, k) for b, q in by.get(at, []))

        assert np.allclose(g, [np.log(total(0, k)) for k in range(2)])


def test_long_words_are_summed_whole(monkeypatch):
    lat = language_id._lattice()
    lp = np.log(np.random.default_rng(2).dirichlet(np.ones(lat.size), 2).T + 1e-12)
    word = "▁" + "internationalisationsarbeiten" * 2
    want = language_id.word_scores(lat, [word], lp)
    monkeypatch.setattr(language_id, "LONGEST", 20)
    for part in (7, 16, 30, 4096):
        monkeypatch.setattr(language_id, "LONG_PART", part)
        assert np.allclose(language_id.word_scores(lat, [word], lp), want)
    assert np.isfinite(language_id.word_scores(lat, ["▁" + "word" * 3000], lp)).all()


def test_quality_on_held_out_labels(spark):
    from curalis.llm import queries

    p = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, p).join(spark.read.parquet(f"{p}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = quality.fit(docs, labels)
    assert 0.5 < m.prior <= 0.98
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, q in y.items()]) > 0.9
    assert all(0 <= r.score <= 1 for r in quality.score(odd, m).collect())
    assert quality.fit(none, labels).w is None and quality.score(odd, quality.Model()).first().score == 0.5


def test_negative_risk_is_not_followed_below_zero():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (400, 1)), rng.normal(-2, 1, (400, 1))
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    w = quality.fit_nonnegative(one(good[:200]), one(np.vstack([good[200:], bad])), 1 / 3)
    s = lambda x: quality._sigmoid(one(x) @ w)
    assert (s(good) > 0.5).mean() > 0.95 and (s(bad) < 0.5).mean() > 0.95
    assert abs(quality.estimate_prior(one(good[:200]), one(np.vstack([good[200:], bad]))) - 1 / 3) < 0.2


CALLS = "conversation long, call_id string, position long, name string, arguments string, depends array<string>, hs string, level string"


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*r, "x", "y") for r in [
        (1, "a", 0, "reply", '{"role":"user","text":"hi"}', []), (1, "b", 1, "reply", '{"text":"","role":"user","x":1}', ["a"]), (1, "c", 2, "other", "{bad", ["zz"]),
        (2, "p", 0, "reply", '{"role":"user","text":"é"}', ["q"]), (2, "q", 1, "reply", None, []), (3, "x", 0, "reply", "{}", ["y"]), (3, "y", 1, "reply", "{}", ["x"]), (1, "a", 5, "reply", "{}", []), (4, None, 0, "reply", "{}", []),
        (5, "a", 0, "reply", '{"role":"user","text":"%s"}' % ("long " * 30_000), []), (None, "a", 0, "context", None, None)]], CALLS)
    results = spark.createDataFrame([(1, "a", 9, "r1"), (1, "a", 8, "r0"), (1, "lost", 3, "z"), (1, None, 1, "n"), (5, "a", 1, None)], "conversation long, call_id string, position long, content string")
    rows = tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS, silent=("context",)).collect()
    got = {(r.conversation, r.call_id): r for r in rows if r.call_id and r.status != "conflicting"}
    assert len(rows) == 14 and sum(r.status == "unidentified" for r in rows) == 2
    a = got[1, "a"]
    assert a.status == "linked" and a.result_position == 8 and a.copies == 4 and a.valid
    assert a.canonical == '{"arguments":{"role":"user","text":"hi"},"id":"a","name":"reply","result":"r0"}'
    assert got[5, "a"].status == "linked" and got[5, "a"].valid and got[None, "a"].status == "silent"
    assert got[1, "b"].violations == "$.text: minLength; $.x: unknown" and "unknown tool" in got[1, "c"].violations and "not JSON" in got[1, "c"].violations and "depends: zz" in got[1, "c"].violations
    assert [got[k].level for k in ((2, "q"), (2, "p"), (3, "x"), (3, "y"), (1, "b"))] == [0, 1, None, None, 1]
    assert got[1, "lost"].status == "orphan" and got[2, "q"].violations == "$: type"
    assert {(r.call_position, r.result_position) for r in rows if r.status == "conflicting"} == {(5, None), (None, 9)}
    assert tool_calls.link(calls.limit(0), results.limit(0), {}).count() == 0


def test_two_conversations_may_use_one_identifier(spark):
    calls = spark.createDataFrame([(k, "call_1", 0, "t", "{}", [], "", "") for k in (1, 2)], CALLS)
    results = spark.createDataFrame([(k, "call_1", 1, f"r{k}") for k in (1, 2)], "conversation long, call_id string, position long, content string")
    assert sorted((r.conversation, json.loads(r.canonical)["result"], r.status) for r in tool_calls.link(calls, results, {"t": {}}).collect()) == [(1, "r1", "linked"), (2, "r2", "linked")]


@pytest.mark.parametrize("small", [10**6, 5])
def test_levels_equal_brute_force(spark, small):
    """Random graphs with forward, backward and unknown dependencies and cycles, in one row and in rounds."""
    rng = np.random.default_rng(9)
    rows = [(c, f"k{i}", [f"k{x}" for x in rng.integers(0, 15, rng.integers(0, 3))] if i % 4 else None) for c in range(8) for i in range(3 + c)]
    rows = [(c if c else None, i, d) for c, i, d in rows]
    want = {}
    for c in {r[0] for r in rows}:
        needs = {i: set(d or []) for x, i, d in rows if x == c}
        level = {}
        while True:
            ready = {i: 1 + max([level[x] for x in d if x in needs], default=-1) for i, d in needs.items() if i not in level and all(x in level for x in d if x in needs)}
            if not ready:
                break
            level.update(ready)
        want |= {(c, i): (level.get(i), sorted(x for x in d if x not in needs) or None) for i, d in needs.items()}
    got = tool_calls.order(spark.createDataFrame(rows, "conversation long, call_id string, depends array<string>"), small).collect()
    assert {(r.conversation, r.call_id): (r.level, r.missing) for r in got} == want and len(got) == len(rows)


@pytest.fixture(scope="session")
def duck():
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_all_ten_are_registered():
    from curalis.llm import queries

    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", ["op1_quality", "op2_media", "op3_packing", "op4_length_histogram", "op5_line_dedup", "op6_minhash", "op7_language", "op8_tool_calls", "op9_decontamination", "op10_sentence_spans"])
def test_registered_query(spark, docs, duck, name):
    from curalis.llm import queries

    got = queries.queries()[name](spark, DATA)
    rows = got.collect()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name])
        cols = [d[0] for d in want.description]
        plain = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
        assert sorted(cols) == sorted(got.columns)
        assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())
    elif name == "op3_packing":
        _check_pieces(rows, docs.collect())
    elif name == "op4_length_histogram":
        assert {r.kind for r in rows} == {"length", "limit", "quantile"} and sum(r.documents for r in rows if r.kind == "length") == docs.count()
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_stages(spark, docs, odd, none, tmp_path):
    """Each stage on the one before, held against plain computations on its own input; then odd and empty tables."""
    import corpus_pipeline as P

    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, d, f"file://{tmp_path}")
        out.write.parquet(f"file://{tmp_path}/stage{k}")
        out, rows = spark.read.parquet(f"file://{tmp_path}/stage{k}"), d.collect()
        kept = {r.doc_id for r in out.collect()}
        if name == "language ID":
            assert all(any(c.isalpha() for c in r.text) for r in rows if r.doc_id in kept) and len(kept) >= 0.97 * len(rows)
        elif name == "line dedup":
            n = {r.doc_id: r.n_removed for r in line_dedup.drop_repeated_lines(d).collect()}
            assert all(r.doc_id in kept for r in rows if not n[r.doc_id])
        elif name == "MinHash near-dedup":
            sets = {r.doc_id: set(minhash_dedup.shingle_set(r.text, 5, "plain").tolist()) for r in rows}
            want = _components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            assert kept == set(want.values())
        elif name == "benchmark decontamination":
            gone = {r.doc_id for r in decontaminate.contained(d, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert kept == {r.doc_id for r in rows} - gone
        else:
            _check_pieces(out.collect(), rows)
        if name != "packing":
            assert out.columns == docs.columns
            o, e = stage(spark, odd, f"file://{tmp_path}"), stage(spark, none, f"file://{tmp_path}")
            assert o.columns == odd.columns and all(r[c] == c for r in o.collect() for c in EXTRA) and e.count() == 0
        d = out


def test_lines_within_the_edit_threshold_all_go(spark):
    rng = np.random.default_rng(5)
    word = lambda *k: "".join(chr(97 + x // 26 % 26) + chr(97 + x % 26) for x in k)
    texts, want = [], []
    for n in [4, 5, 6, 7, 9, 10, 11, 15, 20, 34, 50, 90, 200]:
        base = [word(n, k) for k in range(n)]
        near, far = list(base), list(base)
        for k in rng.choice(n, n // 5 + 1, replace=False):
            far[k] = word(n, k, 1)
        for k in rng.choice(n, n // 5, replace=False):
            near[k] = word(n, k, 2)
        texts += map(" ".join, (base, near, far, base[n // 5 :] if n % 5 == 0 else base))
        want += [0, 1, 0, 1]
    got = {r.doc_id: r.n_removed for r in line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_short_lines_go(spark):
    texts = ["All rights reserved.\nHome\n---\n\nHome", "home\n---\n\nSee also", "all rights reserved\nAll rights kept"]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("All rights reserved.\nHome\n---\n", 1), 1: ("---\n\nSee also", 1), 2: ("All rights kept", 1)}


@pytest.mark.parametrize("n", [51, 55, 60])
def test_passage_inside_long_sentences_is_found_at_any_offset(spark, n):
    rng = np.random.default_rng(n)
    word = lambda k: "".join(chr(97 + int(k) // 26**i % 26) for i in range(5))
    new = lambda size: [word(k) for k in rng.integers(0, 26**5, size)]
    passage = new(n)
    texts = [" ".join(new(k) + passage + new(40 - k)) + "." for k in range(41)]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_dedup.drop_repeated_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == (texts[0], 0) and all(got[k][1] > 0 for k in range(1, 41))
    for k in range(1, 41):
        left = got[k][0].rstrip(".").split()
        assert sum(w in passage for w in left) <= n - 12 and sum(w not in passage for w in left) == 40


def test_sentences_beside_a_repeated_span_stay(spark):
    p = "The old harbour lies behind the hill. Boats leave it before the sun is up! Nobody knows who built the long wall there."
    d = spark.createDataFrame([(1, p), (2, f"First words stand here. {p} End of two.")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_dedup.drop_repeated_sentences(d).collect()}
    assert got == {1: (p, 0), 2: ("First words stand here. End of two.", 3)}
