"""Segmentation-marginalised unigrams (7): a language's likelihood of a text sums over all segmentations.

The pieces are those of a public 32,000-entry vocabulary; only their probabilities in each language are learned,
by EM over the words of a sample of labelled documents (the bound, `train_documents` a language, takes those with the smallest
hash of doc_id). A word is a run of letters (other numerals are none) in lower case after a word mark. Words of any length are summed over all their segmentations: the
forward sum needs only as many places back as the longest piece. (In training, runs of over 64 letters count in stretches of 64.) A
letter outside the vocabulary costs the same in each language. The forward algorithm runs over
many words at once; each worker keeps the words it has scored, in a store that empties when full.

Cases: null text and texts without a letter give `und` with score 0, as do all texts where nothing could be
learned; equal likelihoods go to the first language by name; each row is scored on its own, so repeated rows agree;
a null doc_id counts as an empty one for the fold and is not learned from; extra columns pass through `identify` whatever their names, and
where one has the name of a result column that one gets an underscore; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import enter, free_name, materialize, ship, store

LONGEST = 64
LONG_PART = 4096
SCALE = 64.0  # keeps probabilities of long words inside doubles: about one letter's perplexity
UNKNOWN = 1e-5
_RUN = re.compile(r"[^\W\d_]+")
MARK = "▁"
_MUL, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """All pieces of the fixed vocabulary that lie in words, found length by length over one array of letters."""

    SLOTS = 1 << 18

    def __init__(self, model: str = "piece_bpe_32k.model"):
        import public_tokenizers as P
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=P.path(model))
        self.size = sp.get_piece_size()
        by: dict[int, list[tuple[int, int]]] = {}
        for i in range(self.size):
            x = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or MARK in x[1:]):
                by.setdefault(len(x), []).append((int(self._hash(np.array([[ord(c) for c in x]], np.uint64))[0]), i))
        self.by = {}
        for n, found in sorted(by.items()):
            h = np.array([a for a, _ in found], np.uint64)
            order = np.argsort(h)
            if (h[order][1:] == h[order][:-1]).any():
                raise ValueError("two pieces have one hash")
            some = np.zeros(self.SLOTS, bool)
            some[self._slot(h)] = True
            self.by[n] = some, h[order], np.array([b for _, b in found], np.int64)[order]

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in rows.T:
            h = h * _MUL + c
        return h

    @classmethod
    def _slot(cls, h: np.ndarray) -> np.ndarray:
        return (h * _MIX >> np.uint64(46)).astype(np.int64)

    def edges(self, words: list[str]):
        """Arrays (word, from, to, piece) and the words' lengths; piece -1 is a letter outside the vocabulary."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(n + 1) - n - 1
        word_at = np.repeat(np.arange(len(words)), n + 1)[: len(letters)]
        known = np.zeros(len(letters), bool)
        known[(begin + n)[:-1]] = True
        at, size, piece = [], [], []
        h, done = np.zeros(len(letters), np.uint64), 0
        for length, (some, hashes, ids) in self.by.items():
            if length > len(letters):
                break
            while done < length:
                h = h[: len(letters) - done] * _MUL + letters[done:]
                done += 1
            x = np.flatnonzero(some[self._slot(h)])
            k = np.searchsorted(hashes, h[x])
            ok = hashes[np.minimum(k, len(hashes) - 1)] == h[x]
            x, k = x[ok], k[ok]
            if length == 1:
                known[x] = True
            at.append(x)
            size.append(np.full(len(x), length))
            piece.append(ids[k])
        lone = np.flatnonzero(~known)
        at, size, piece = np.concatenate([*at, lone]), np.concatenate([*size, np.ones(len(lone), np.int64)]), np.concatenate([*piece, np.full(len(lone), -1)])
        w = word_at[at]
        frm = at - begin[w]
        return w, frm, frm + size, piece, n


def sweep(w: np.ndarray, frm: np.ndarray, to: np.ndarray, step: np.ndarray, words: int, longest: int) -> np.ndarray:
    """value[position, word, language]: sums of products of steps over all ways from position 0. A word has one edge at most between two positions."""
    key = (to * 256 + (to - frm)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    key, w, step = key[order], w[order], step[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    value = np.zeros((longest + 1, words, step.shape[1]))
    value[0] = 1
    for lo, hi in zip(heads, [*heads[1:], len(key)]):
        k, size = divmod(int(key[lo]), 256)
        own = w[lo:hi]
        value[k, own] += value[k - size, own] * step[lo:hi]
    return value


def _parts(words: list[str], size: int = 20_000):
    for k in range(0, len(words), size):
        yield slice(k, min(k + size, len(words)))


def word_scores(lattice: Lattice, words: list[str], log_prob: np.ndarray) -> np.ndarray:
    """log P(word | language), all segmentations summed; a row for each word."""
    out = np.zeros((len(words), log_prob.shape[1]))
    prob = np.vstack([np.exp(log_prob), np.full(log_prob.shape[1], UNKNOWN)])
    size = np.fromiter(map(len, words), np.int64, len(words))
    for x in np.flatnonzero(size > LONGEST + 1):
        out[x] = _long_score(lattice, words[x], prob)
    short = np.flatnonzero(size <= LONGEST + 1)
    for k in _parts(short):
        w, i, j, p, n = lattice.edges([words[x] for x in short[k]])
        a = sweep(w, i, j, prob[p] * (SCALE ** (j - i))[:, None], len(n), int(n.max()))
        out[short[k]] = np.log(np.maximum(a[n, np.arange(len(n))], 1e-300)) - n[:, None] * np.log(SCALE)
    return out


def _long_score(lattice: Lattice, word: str, prob: np.ndarray) -> np.ndarray:
    """The same for one word of any length, with as many sums held as the longest piece has letters."""
    out, tail, begin = np.zeros(prob.shape[1]), None, 0
    back = max(lattice.by)
    for begin in range(0, len(word), LONG_PART):  # edges are looked up part by part; those that reach over a part's end belong to the next
        part = word[max(0, begin - back) : begin + LONG_PART]
        shift = begin - max(0, begin - back)
        _, i, j, p, _ = lattice.edges([part])
        ok = j > shift
        i, j, p = i[ok], j[ok], p[ok]
        order = np.argsort(j, kind="stable")
        i, j, p = i[order], j[order], p[order]
        step = prob[p] * (SCALE ** (j - i))[:, None]
        heads = np.searchsorted(j, np.arange(shift + 1, len(part) + 2))
        value = np.zeros((len(part) + 1, prob.shape[1]))
        if tail is None:
            value[0] = 1
        else:
            value[shift + 1 - len(tail) : shift + 1] = tail
        for k in range(shift + 1, len(part) + 1):
            lo, hi = heads[k - shift - 1], heads[k - shift]
            value[k] = (value[i[lo:hi]] * step[lo:hi]).sum(axis=0)
            if k % 32 == 0:
                top = np.maximum(value[max(0, k - back) : k + 1].max(axis=0), 1e-300)
                value[max(0, k - back) : k + 1] /= top
                out += np.log(top)
        tail = value[-min(back + 1, len(value)) :].copy()
    return out + np.log(np.maximum(tail[-1], 1e-300)) - len(word) * np.log(SCALE)


def expected_counts(lattice: Lattice, words: list[str], count: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece: count has a row for each word and a column for each language."""
    total = np.zeros((log_prob.shape[0] + 1, log_prob.shape[1]))
    prob = np.vstack([np.exp(log_prob), np.full(log_prob.shape[1], UNKNOWN)])
    for k in _parts(words):
        w, i, j, p, n = lattice.edges(words[k])
        step = prob[p] * (SCALE ** (j - i))[:, None]
        a = sweep(w, i, j, step, len(n), int(n.max()))
        b = sweep(w, n[w] - j, n[w] - i, step, len(n), int(n.max()))
        z = np.maximum(a[n, np.arange(len(n))], 1e-300)
        use = a[i, w] * step * b[n[w] - j, w] / z[w] * count[k][w]
        for x in range(use.shape[1]):
            total[:, x] += np.bincount(p % len(total), use[:, x], len(total))
    return total[:-1]


def pieces_of(token: str) -> list[str]:
    """The words of a lower-cased token: its runs of letters."""
    if token.isalpha():
        return [MARK + token]
    out = []
    for r in _RUN.findall(token):
        out += [MARK + x for x in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]
    return out


def _stretches(token: str) -> list[str]:
    return [x[i : i + LONGEST] for x in pieces_of(token) for i in range(0, len(x), LONGEST)]


class Scorer(dict):
    """token -> row of its summed word scores, its words and letters; kept in a worker, bounded in rows, their bytes and letters."""

    def __init__(self, log_prob: np.ndarray, lattice: Lattice, limit: int = 400_000, most_letters: int = 8_000_000):
        super().__init__()
        self.log_prob, self.lattice, self.most_letters, self.letters = log_prob, lattice, most_letters, 0
        self.limit = max(8000, min(limit, (16 << 20) // (4 * log_prob.shape[1] + 8)))
        self.rows, self.new = np.zeros((self.limit, log_prob.shape[1] + 2), np.float32), []

    def __missing__(self, token: str) -> int:
        self.letters += len(token)
        k = self[token] = len(self)
        self.new.append(token)
        return k

    def score(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its log-likelihood in each language, then its numbers of words and of letters."""
        out = np.zeros((len(texts), self.rows.shape[1]))
        owner: list[int] = []
        group: list[np.ndarray] = []
        held, most = 0, self.limit // 8
        for k, t in enumerate(texts):
            tokens = t.lower().split() if t else []
            for i in range(0, len(tokens), most):
                part = tokens[i : i + most]
                if held and held + len(part) > most:
                    self._add(out, owner, group)
                    owner, group, held = [], [], 0
                if not held and (len(self) + most > self.limit or self.letters > self.most_letters):
                    self.clear()
                    self.letters = 0
                group.append(np.fromiter(map(self.__getitem__, part), np.int64, len(part)))
                owner.append(k)
                held += len(part)
        self._add(out, owner, group)
        return out

    def _add(self, out: np.ndarray, owner: list[int], group: list[np.ndarray]) -> None:
        if not group:
            return
        words, of, size = [], [], []
        for k, t in enumerate(self.new):
            for x in pieces_of(t):
                words.append(x)
                of.append(k)
                size.append(len(x) - 1)
        first = len(self) - len(self.new)
        add = np.zeros((len(self.new), self.rows.shape[1]))
        if words:
            got = word_scores(self.lattice, words, self.log_prob)
            for x in range(got.shape[1]):
                add[:, x] = np.bincount(of, got[:, x], len(add))
            add[:, -2] = np.bincount(of, minlength=len(add))
            add[:, -1] = np.bincount(of, size, len(add))
        self.rows[first : len(self)] = add
        self.new = []
        heads = np.cumsum([0, *map(len, group)])[:-1]
        np.add.at(out, owner, np.add.reduceat(self.rows[np.concatenate(group)].astype(float), heads, axis=0))


_lattices: dict[str, Lattice] = {}
_scorers: dict[int, Scorer] = {}
store(_lattices.clear)
store(_scorers.clear)


def _lattice() -> Lattice:
    if "one" not in _lattices:
        _lattices["one"] = Lattice()
    return _lattices["one"]


def _scorer(model_id: int, log_prob: np.ndarray) -> Scorer:
    if model_id not in _scorers:
        _scorers.clear()
        _scorers[model_id] = Scorer(log_prob, _lattice())
    return _scorers[model_id]


def fit(labelled: DataFrame, train_documents: int = 1500, rounds: int = 2, smooth: float = 0.2) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [piece, language]) from labelled(doc_id, text, lang).

    What reaches the driver is one row a language and piece of the fixed vocabulary.
    """
    ship(labelled.sparkSession)
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select("lang", "text", "doc_id")
    # first among few documents each, then among those that are left: no task meets a language whole
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(256)))
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).filter(F.col("r") <= train_documents).drop("r")
    ids = materialize(ids.select("lang", "doc_id"), "train")
    rows = rows.join(ids, ["lang", "doc_id"])

    def count(batches):
        enter("language")
        for b in batches:
            n: dict = {}
            for lang, text in zip(b["lang"], b["text"]):
                own = n.setdefault(lang, {})
                for t in text.lower().split():
                    own[t] = own.get(t, 0) + 1
            yield pd.DataFrame([(k, t, c) for k, own in n.items() for t, c in own.items()], columns=["lang", "token", "n"])

    words = materialize(rows.mapInPandas(count, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")), "words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = _lattice().size
    log_prob = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        def expect(batches, lp=log_prob):
            enter("language")
            number = {x: i for i, x in enumerate(langs)}
            total = np.zeros((size, len(langs)))
            for b in batches:
                ws, c = [], []
                for lang, t, n in zip(b["lang"], b["token"], b["n"]):
                    for x in _stretches(t):
                        ws.append(x)
                        c.append((number[lang], n))
                if ws:
                    count = np.zeros((len(ws), len(langs)))
                    count[np.arange(len(ws)), [k for k, _ in c]] = [n for _, n in c]
                    total += expected_counts(_lattice(), ws, count, lp)
            p, k = np.nonzero(total)
            yield pd.DataFrame({"piece": p, "lang": k, "n": total[p, k]})

        got = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.full((size, len(langs)), smooth)
        total[got["piece"], got["lang"]] += got["n"]
        log_prob = np.log(total / total.sum(axis=0))
    return langs, log_prob


def identify(docs: DataFrame, langs: list[str], log_prob: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the posterior of lang_pred under equal priors) and fit (mean log-likelihood of a letter in lang_pred; null for `und`)."""
    import uuid

    ship(docs.sparkSession)
    lp, model_id = log_prob.astype(np.float32), uuid.uuid4().int

    @F.pandas_udf("struct<lang_pred string, score double, fit double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        enter("language")
        if not langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "fit": [None] * len(texts)})
        x = _scorer(model_id, lp.astype(float)).score(list(texts))
        some, letters, x = x[:, -2] > 0, x[:, -1], x[:, :-2]
        best = x.argmax(axis=1)
        post = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
        fit = pd.Series(x.max(axis=1) / np.maximum(letters, 1)).where(some)
        return pd.DataFrame({"lang_pred": np.where(some, np.array(langs, object)[best], "und"), "score": np.where(some, post, 0.0), "fit": fit})

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), predict(F.col(text)).alias("_p"))
    return row.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], *[F.col(f"_p.{c}").alias(free_name(docs, c)) for c in ("lang_pred", "score", "fit")])


def fold(docs: DataFrame, parts: int) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))
