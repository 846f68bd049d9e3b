"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its padded letter trigrams, itself, and the lexicons that list it (the
commonest words of each language in the training sample). Weights of features and of transitions between
languages are learned together by maximum likelihood; forward-backward gives each word the probability of
each language in its line, so switches within a text are seen. A document's language is the one with the
largest mean probability over its words, which is its score.

Training takes at most ``DOCS`` labelled documents of each language, the first by a hash of their id, of each of
them ``CHARS`` characters from a place that the hash draws, and ``RUNS`` runs of words from random places of
those; they are spliced so that some sequences switch language. Prediction reads every word of every line of
every whole text, and nothing but the text; a line is one sequence, a longer one than ``SEQUENCE`` words several.

Defined cases: null, empty and letterless texts get ``und`` and score 0; ties go to the language that sorts
first; repeated rows give one row each; without labelled rows every document gets ``und``; further columns
pass through (new ones replace columns with the same name); an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm.batches import give_back, slices

DOCS, CHARS, RUNS, RUN = 300, 8000, 6, 24
#: Weights per language; lexicon words per language; words that a worker keeps scores of; words of a sequence.
BUCKETS, LEXICON, CACHED, SEQUENCE = 1 << 17, 200, 50_000, 400
#: Bytes of text that are scored at once.
READ = 1 << 20
UNKNOWN = "und"
WORD = re.compile(r"\p{L}+")


def features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    w = f"^{word}$"
    names = ["=" + word, "<" + w[:3], "<" + w[:4], ">" + w[-2:], ">" + w[-3:], ">" + w[-4:], *{w[k : k + 3] for k in range(len(w) - 2)}]
    return [crc32(n.encode()) % BUCKETS for n in names] + [BUCKETS + k for k in lexicons.get(word, ())]


def marginals(emission, lengths, trans, start):
    """Forward-backward over sequences that lie one after another: word by language probabilities, and what transitions are expected.

    Step t handles the t-th word of all sequences that are that long at once.
    """
    import numpy as np

    n, size = emission.shape
    order = np.argsort(-lengths, kind="stable")
    first, sized = (np.cumsum(lengths) - lengths)[order], lengths[order]
    e = np.exp(emission - emission.max(1, keepdims=True))
    move, begin = np.exp(trans), np.exp(start)
    alpha, beta = np.empty((n, size), e.dtype), np.ones((n, size), e.dtype)
    active = np.searchsorted(-sized, -np.arange(sized[0] if len(sized) else 0), side="left")  # sequences longer than t
    for t, k in enumerate(active):
        at = first[:k] + t
        a = (begin if t == 0 else alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (e[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    inner = np.ones(n, bool)
    inner[first + sized - 1] = False
    at = np.flatnonzero(inner)
    return p, at, alpha, e, beta, move


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = DOCS, seed: int = 8, epochs: int = 4) -> dict:
    """The model: languages, weights, transitions, lexicons."""
    import numpy as np

    by = Window.partitionBy(lang).orderBy("h", key)
    ids = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(lang, key, F.xxhash64(key).alias("h"))
    # of a large language only low hashes go to its window, four times as many as it keeps; languages are few, since each has a column of weights
    many = ids.groupBy(lang).agg(F.least(F.lit(1.0), 4.0 * docs / F.count("*")).alias("share"))
    low = ids.join(F.broadcast(many), lang).where(F.col("h").cast("double") <= F.col("share") * 2.0**64 - 2.0**63)
    chosen = low.withColumn("n", F.row_number().over(by)).where(F.col("n") <= docs).select(key, lang)
    rng = np.random.default_rng(seed)
    runs: dict[str, list[list[str]]] = {}
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.lit(1), F.length(text) - CHARS + 1)).cast("int") + 1
    for r in labelled.where(F.col(lang).isNotNull()).select(key, lang, F.substring(text, place, F.lit(CHARS)).alias(text)).join(F.broadcast(chosen), [key, lang], "left_semi").orderBy(lang, key).toLocalIterator():
        words = WORD.findall((r[text] or "").lower())
        for a in rng.integers(0, max(1, len(words) - RUN // 2), RUNS) if words else ():
            runs.setdefault(r[lang], []).append(words[a : a + RUN])
    langs = sorted(runs)
    if not langs:
        return {"langs": []}
    lexicons: dict[str, list[int]] = {}
    for k, name in enumerate(langs):
        for w, _ in sorted(Counter(w for run in runs[name] for w in run).items(), key=lambda v: (-v[1], v[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(k)
    # a sequence is a run, or two cut halves of runs of any two languages
    pairs = [(k, run) for k, name in enumerate(langs) for run in runs[name]]
    sequences = []
    for k in rng.permutation(len(pairs)):
        (a, x), (b, y) = pairs[k], pairs[rng.integers(len(pairs))]
        if rng.random() < 0.5:
            x, y = x[: max(1, len(x) // 2)], y[len(y) // 2 :]
            sequences.append((x + y, [a] * len(x) + [b] * len(y)))
        else:
            sequences.append((x, [a] * len(x)))
    size, known = len(langs), {}
    for words, _ in sequences:
        for w in words:
            if w not in known:
                known[w] = np.array(features(w, lexicons))
    weights, trans, start = np.zeros((BUCKETS + size, size)), np.zeros((size, size)), np.zeros(size)
    squares = [np.full_like(v, 1e-2) for v in (weights, trans, start)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 48)):
            own = [sequences[k] for k in part]
            lengths = np.array([len(w) for w, _ in own])
            feats = [known[w] for ws, _ in own for w in ws]
            counts = np.array([len(f) for f in feats])
            flat, gold = np.concatenate(feats), np.array([y for _, ys in own for y in ys])
            emission = np.add.reduceat(weights[flat], np.cumsum(counts) - counts, axis=0)
            p, at, alpha, e, beta, move = marginals(emission, lengths, trans, start)
            error = -p
            error[np.arange(len(gold)), gold] += 1
            pair = alpha[at][:, :, None] * move * (e[at + 1] * beta[at + 1])[:, None, :]
            expected = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            seen = np.zeros((size, size))
            np.add.at(seen, (gold[at], gold[at + 1]), 1)
            heads = np.cumsum(lengths) - lengths
            touched, back = np.unique(flat, return_inverse=True)
            g = np.zeros((len(touched), size))
            np.add.at(g, back, np.repeat(error, counts, axis=0))
            steps = ((weights, squares[0], touched, g - 1e-3 * weights[touched]), (trans, squares[1], ..., seen - expected - 1e-2 * trans), (start, squares[2], ..., error[heads].sum(0)))
            for value, square, where, grad in steps:
                grad = grad / len(own)
                square[where] += grad**2
                value[where] += 0.3 * grad / np.sqrt(square[where])
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": trans.astype(np.float32), "start": start.astype(np.float32), "lexicons": lexicons}


class _Scorer:
    """Emission scores of words, kept while there is room."""

    def __init__(self, model: dict):
        self.model, self.ids, self.rows = model, {}, None

    def emissions(self, words: list[str]):
        import numpy as np

        if len(self.ids) > CACHED:
            self.ids, self.rows = {}, None
        new = [w for w in set(words) if w not in self.ids]
        if new:
            feats = [features(w, self.model["lexicons"]) for w in new]
            counts = np.array([len(f) for f in feats])
            flat = np.fromiter((k for f in feats for k in f), np.int64, int(counts.sum()))
            scores = np.add.reduceat(self.model["weights"][flat], np.cumsum(counts) - counts, axis=0)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.rows = scores if self.rows is None else np.concatenate([self.rows, scores])
        return self.rows[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]


def predict(df: DataFrame, model: dict, text: str = "text", out: str = "lang_pred", score: str = "score", words: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with the predicted language and its score; ``words`` names a column for the language of each word, in order."""
    added = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())] + ([T.StructField(words, T.ArrayType(T.StringType()))] if words else [])
    left = [f for f in df.schema if f.name not in {a.name for a in added} and (keep_text or f.name != text)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scorer, langs = _Scorer(shared.value), shared.value["langs"]
        for x in slices(batches, text, 2000, READ):
            flat, lengths, sizes = [], [], []
            for t in x.column(text).to_pylist() if langs else [None] * x.num_rows:
                before = len(flat)
                for line in (t or "").lower().split("\n"):
                    found = WORD.findall(line)
                    if found:
                        flat += found
                        lengths += [SEQUENCE] * (len(found) // SEQUENCE) + [len(found) % SEQUENCE] * (len(found) % SEQUENCE > 0)
                sizes.append(len(flat) - before)
            best, value, labels = [UNKNOWN] * x.num_rows, [0.0] * x.num_rows, [[] for _ in sizes]
            if flat:
                p = marginals(scorer.emissions(flat), np.array(lengths), shared.value["trans"], shared.value["start"])[0]
                full = np.flatnonzero(sizes)
                own = np.array(sizes)[full]
                starts = np.cumsum(own) - own
                mean = np.add.reduceat(p.astype(np.float64), starts, axis=0) / own[:, None]
                for k, row, m in zip(full.tolist(), mean, mean.argmax(1).tolist()):
                    best[k], value[k] = langs[m], min(1.0, float(row[m]))
                if words:
                    top = p.argmax(1)
                    for k, a, n in zip(full.tolist(), starts.tolist(), own.tolist()):
                        labels[k] = [langs[v] for v in top[a : a + n]]
            arrays = [pa.array(best, pa.string()), pa.array(value, pa.float64())] + ([pa.array(labels, pa.list_(pa.string()))] if words else [])
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in left), *arrays], names=[*(f.name for f in left), *(a.name for a in added)])
        del scorer
        give_back()

    return df.mapInArrow(run, T.StructType([*left, *added]))


def held_out(key: str = "doc_id") -> Column:
    """The fold that training leaves out, by the checksum of the id's text."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2
