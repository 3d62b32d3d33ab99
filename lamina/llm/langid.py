"""Language identification by a linear-chain conditional random field over words.

Words are separated by white space and lower-cased; only their letters count, and a word without letters has no
evidence of its own. Features of a word: all character n-grams of length 1 to 4 of the word between
boundary marks (those at a mark are its affixes), hashed, and its entry in the lexicon of each language. Transition
weights are learned with the feature weights by stochastic gradients of the exact log-likelihood, on sequences of which
some are cut from two texts, so that the model meets code-switching. Forward-backward gives every word's posterior, and so
every word's language; a text's language has the largest mean posterior, which is its score.

The model is fitted on the driver from a bounded sample of labelled rows: about ``per_lang`` documents for each
language, chosen by a hash of their ids, and of a longer text a stretch of ``sample_chars``. Its size is ``BUCKETS``
floats for each language, and the sample's words. Prediction covers every word of every text; a text of more than
``SEGMENT`` words is labelled a segment at a time, its messages carried over the borders.

Defined results: a null or empty text or one without letters is ``und`` with score 0 and has no labels; rows with a null
id are predicted, never learned from and not held out; rows that repeat an id are learned from and predicted each; of
tied languages the first by code point counts; if nothing can be learned, everything is ``und``; an empty table gives an
empty one. Only lang and text are read besides the id, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
HELD = 2  # of crc32(id) mod 4
MEMO = 300_000  # words whose emissions a worker remembers
SEGMENT = 1 << 18  # words of one text that are labelled at a time
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lens)
    owners, buckets = [], []
    value = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = (value[: len(chars) - n + 1] if n > 1 else value) * _P + chars[n - 1 :] + np.uint64(1)
        own = np.flatnonzero(word[: len(chars) - n + 1] == word[n - 1 :])
        owners.append(own)
        buckets.append((mix(value[own] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return word[np.concatenate(owners)], np.concatenate(buckets)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x langs
    lexicon: dict[str, int]  # word -> its language
    lexicon_weights: np.ndarray  # langs x langs
    transitions: np.ndarray  # langs x langs, logs
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the words' scores, largest 1."""
        out = np.zeros((len(words), len(self.langs)))
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            word, bucket = features(some)
            for k in range(len(self.langs)):
                out[i : i + len(some), k] = np.bincount(word, weights=self.weights[bucket, k], minlength=len(some))
        lex = np.array([self.lexicon.get(w, -1) for w in words])
        out[lex >= 0] += self.lexicon_weights[lex[lex >= 0]]
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -30))


def posteriors(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences padded at their end (B x T x L): posteriors of the words, expected transitions."""
    b, t, n = e.shape
    alpha = np.empty((t, b, n))
    scale = np.empty((t, b, 1))
    now = start * e[:, 0]
    for i in range(t):
        if i:
            step = (now @ trans) * e[:, i]
            now = np.where(mask[:, i, None], step, now)
        scale[i] = now.sum(axis=1, keepdims=True)
        now = now / scale[i]
        alpha[i] = now
    post, pairs = np.zeros((b, t, n)), np.zeros((n, n))
    beta = np.ones((b, n))
    for i in range(t - 1, -1, -1):
        post[:, i] = alpha[i] * beta * mask[:, i, None]
        if i:
            right = e[:, i] * beta / scale[i]
            m = mask[:, i, None]
            pairs += (alpha[i - 1] * m).T @ (right * m)
            beta = np.where(m, right @ trans.T, beta)
    return post, pairs * trans


def fit(sample: list[tuple[str, str]], steps: int = 200, batch: int = 192, length: int = 24, seed: int = 5) -> Model | None:
    """A model from (text, lang) pairs; None if they hold no words."""
    docs = [(w, lang) for text, lang in sorted(sample) if (w := [x for x in map(letters, words_of(text)) if x])]
    langs = sorted({lang for _, lang in docs})
    if not langs:
        return None
    place = {lang: i for i, lang in enumerate(langs)}
    n, rng = len(langs), np.random.default_rng(seed)
    counts: dict[str, Counter] = {}
    for words, lang in docs:
        for w in words:
            counts.setdefault(w, Counter())[place[lang]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if (s := sum(c.values())) >= 3 and c.most_common(1)[0][1] >= 0.9 * s}
    vocabulary = {w: i for i, w in enumerate(counts)}
    texts = [np.array([vocabulary[w] for w in words]) for words, _ in docs]
    label = np.array([place[lang] for _, lang in docs])
    of_lang = [np.flatnonzero(label == k) for k in range(n)]
    word, bucket = features(list(vocabulary))
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    cut = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    lex = np.array([lexicon.get(w, -1) for w in vocabulary])
    weights, lex_w, trans, start = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    seen = [np.full(x.shape, 1e-3) for x in (weights, lex_w, trans, start)]

    def cutting(size: int) -> tuple[np.ndarray, int]:
        d = int(rng.choice(of_lang[int(rng.integers(n))]))
        a = int(rng.integers(max(1, len(texts[d]) - size + 1)))
        return texts[d][a : a + size], int(label[d])

    for step in range(steps):
        ids, y, mask = np.zeros((batch, length), np.int64), np.zeros((batch, length), np.int64), np.zeros((batch, length), bool)
        for b in range(batch):
            at = 0
            for size in (length,) if rng.random() < 0.6 else (length // 2, length - length // 2):
                w, k = cutting(size)
                ids[b, at : at + len(w)], y[b, at : at + len(w)], mask[b, at : at + len(w)] = w, k, True
                at += len(w)
        used, inverse = np.unique(ids, return_inverse=True)
        size = cut[used + 1] - cut[used]
        spot = np.repeat(cut[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner, feats = np.repeat(np.arange(len(used)), size), bucket[spot]
        # half of the words lose their lexicon entry: n-grams must do for words never seen
        has = (lex[used] >= 0) & (rng.random(len(used)) < 0.5)
        score = np.stack([np.bincount(owner, weights=weights[feats, k], minlength=len(used)) for k in range(n)], axis=1)
        score[has] += lex_w[lex[used][has]]
        e = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))[inverse.reshape(batch, length)]
        post, pairs = posteriors(e, mask, np.exp(trans), np.exp(start))
        one = np.eye(n)[y] * mask[..., None]
        grad = np.zeros((len(used), n))
        np.add.at(grad, inverse.ravel(), (one - post).reshape(-1, n))
        lex_grad = np.zeros((n, n))
        np.add.at(lex_grad, lex[used][has], grad[has])
        true = np.zeros((n, n))
        inner = mask[:, 1:]
        np.add.at(true, (y[:, :-1][inner], y[:, 1:][inner]), 1)
        touched = np.unique(feats)
        slot = np.searchsorted(touched, feats)
        dense = np.stack([np.bincount(slot, weights=grad[owner, k], minlength=len(touched)) for k in range(n)], axis=1) / batch - 1e-4 * weights[touched]
        seen[0][touched] += dense**2
        weights[touched] += 0.3 * dense / np.sqrt(seen[0][touched])
        for x, g, s in zip((lex_w, trans, start), (lex_grad / batch - 1e-3 * lex_w, (true - pairs) / batch, (one[:, 0] - post[:, 0]).sum(axis=0) / batch), seen[1:], strict=True):
            s += g**2
            x += 0.2 * g / np.sqrt(s)
    return Model(langs, weights.astype(np.float32), lexicon, lex_w, trans, start)


class Labeller:
    """Posteriors of whole texts. Emissions of words are remembered, up to ``MEMO`` words; row 0 is for no letters."""

    def __init__(self, model: Model) -> None:
        self.model, self.place, self.store = model, {}, np.ones((1, len(model.langs)), np.float32)
        self.trans, self.start = np.exp(model.transitions).astype(np.float32), np.exp(model.start).astype(np.float32)

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        """The words' rows in ``store``, text after text."""
        new = set().union(*texts).difference(self.place)
        if new:
            if len(self.place) + len(new) > MEMO:
                self.place, self.store = {}, self.store[:1]
                new = set().union(*texts)
            some = [(w, x) for w in sorted(new) if (x := letters(w))]
            self.place.update(dict.fromkeys(new, 0))
            self.place.update(zip((w for w, _ in some), range(len(self.store), len(self.store) + len(some)), strict=True))
            if some:
                self.store = np.concatenate([self.store, self.model.emissions([x for _, x in some]).astype(np.float32)])
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """The posterior of each word, text after text.

        Words of all texts go step by step, longest text first: at each step the texts that still have a word are a
        prefix, so nothing is padded.
        """
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(texts))
        longest = int(lens.max(initial=0))
        active = len(texts) - np.searchsorted(np.sort(lens), np.arange(longest), "right")  # texts with more than i words
        at = np.r_[0, np.cumsum(active)]
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        spot = at[step] + np.repeat(rank, lens)
        rows = np.empty(len(spot), np.int64)
        rows[spot] = self.rows(texts)
        e = self.store[rows]
        alpha = np.empty_like(e)
        now = np.broadcast_to(self.start, (active[0] if longest else 0, len(self.start)))
        for i in range(longest):
            a, b = at[i], at[i + 1]
            now = (now[: b - a] @ self.trans if i else now) * e[a:b]
            now /= now.sum(axis=1, keepdims=True)
            alpha[a:b] = now
        beta = np.ones((0, len(self.start)), np.float32)
        for i in range(longest - 1, -1, -1):
            a, b = at[i], at[i + 1]
            if b - a > len(beta):
                beta = np.concatenate([beta, np.ones((b - a - len(beta), len(self.start)), np.float32)])
            alpha[a:b] *= beta
            beta = (e[a:b] * beta) @ self.trans.T
            beta /= beta.sum(axis=1, keepdims=True)
        alpha /= alpha.sum(axis=1, keepdims=True)
        return alpha[spot]  # text after text again

    def in_segments(self, words: list[str], segment: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, posteriors) of the segments of one long text, last segment first."""

        def forward(a: int, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = self.rows([words[a : a + segment]])  # may renew the store
            e = self.store[rows]
            alpha = np.empty_like(e)
            for i in range(len(e)):
                now = (now @ self.trans if a + i else self.start) * e[i]
                now = now / now.sum()
                alpha[i] = now
            return e, alpha

        starts = list(range(0, len(words), segment))
        before = [self.start]  # forward messages at the segments' starts
        for a in starts[:-1]:
            before.append(forward(a, before[-1])[1][-1])
        beta = np.ones(len(self.start), np.float32)
        for a, now in zip(reversed(starts), reversed(before), strict=True):
            e, alpha = forward(a, now)
            for i in range(len(e) - 1, -1, -1):
                alpha[i] *= beta
                beta = self.trans @ (e[i] * beta)
                beta = beta / beta.sum()
            yield a, alpha / alpha.sum(axis=1, keepdims=True)

    def labelled(self, texts: list[list[str]], segment: int = SEGMENT) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The mean posterior of each text (zeros without words), and its runs of words of one language: first word, language."""
        means, runs = np.zeros((len(texts), len(self.start))), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= segment]
        if short:
            lens = np.array([len(texts[i]) for i in short])
            head = np.cumsum(lens) - lens
            post = self([texts[i] for i in short])
            means[short] = np.add.reduceat(post, head, axis=0, dtype=np.float64) / lens[:, None]
            best = post.argmax(axis=1)
            new = np.r_[True, best[1:] != best[:-1]]
            new[head] = True
            at = np.flatnonzero(new)
            cut = np.searchsorted(at, np.r_[head, len(best)])
            for j, i in enumerate(short):
                own = at[cut[j] : cut[j + 1]]
                runs[i] = own - head[j], best[own]
        for i, t in enumerate(texts):
            if len(t) > segment:
                best = np.zeros(len(t), np.int64)
                for a, post in self.in_segments(t, segment):
                    means[i] += post.sum(axis=0, dtype=np.float64) / len(t)
                    best[a : a + len(post)] = post.argmax(axis=1)
                at = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
                runs[i] = at, best[at]
        return means, runs


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD, F.lit(False))


def sampled(docs: DataFrame, per_lang: int, sample_chars: int = 20_000) -> list[tuple[str, str]]:
    """About ``per_lang`` (text, lang) pairs of each language, by a hash of the id; never a held-out row."""
    able = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return []
    share = F.element_at(F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(per_lang / r["count"])))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1)
    cut = F.substring("text", start.cast("int"), F.lit(sample_chars))
    return [(r["cut"], r["lang"]) for r in able.where(F.coalesce(drawn < share, F.lit(False))).select(cut.alias("cut"), "lang").collect()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _runs(found: list[tuple[np.ndarray, np.ndarray]], lens: list[int], langs: list[str]) -> pa.Array:
    size = np.array([len(at) for at, _ in found], np.int64)
    start = np.concatenate([at for at, _ in found]).astype(np.int64)
    stop = np.concatenate([np.r_[at[1:], n] if len(at) else at for (at, _), n in zip(found, lens, strict=True)]).astype(np.int64)
    lang = pa.array(langs, pa.string()).take(pa.array(np.concatenate([k for _, k in found]).astype(np.int64)))
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(stop), lang], fields=list(_RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), runs)


def labelled(docs: DataFrame, per_lang: int = 200, steps: int = 200, sample_chars: int = 20_000) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, n_words, labels (start, end, lang of each run of words of one language).

    Words are numbered from 0, separated by white space; end is exclusive.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"))
    model = fit(sampled(named, per_lang, sample_chars), steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * langs floats and the sample's words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        label = Labeller(own) if own else None
        langs = own.langs if own else [UNKNOWN]
        for batch in batches:
            for part in pieces(batch, "text", max(1 << 20, (32 << 20) // max(4, len(langs)))):
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                able = [bool(own) and any(map(letters, t)) for t in texts]
                told = [t if x else [] for t, x in zip(texts, able, strict=True)]
                means, runs = label.labelled(told) if label else (np.zeros((len(texts), 1)), [(np.zeros(0, np.int64),) * 2] * len(texts))
                lang = [langs[int(m.argmax())] if x else UNKNOWN for x, m in zip(able, means, strict=True)]
                score = [min(1.0, float(m.max())) if x else 0.0 for x, m in zip(able, means, strict=True)]
                cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), _runs(runs, [len(t) for t in told], langs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *cols], ["doc_id", "held_out", "lang_pred", "score", "n_words", "labels"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, labels array<struct<start:long,end:long,lang:string>>"
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
