"""Language identification by a linear-chain conditional random field over words.

Each word has features of its affixes and character n-grams (hashed) and of a lexicon; the chain has learned transitions, so the
words of a text that switches languages are labelled by forward-backward in the light of their neighbours. A document's language
is the one with the largest mean marginal over its words with a letter, and that mean is its score.

Training reads text and lang alone. The lexicon counts the words of up to SHORT letters of every training document and keeps the
LEXICON most frequent of each language. Weights are fitted to spans of CHAIN words of at most SAMPLE documents per language (the
smallest hashes of doc_id), part of them joined to chains that switch. Prediction reads text alone and whole; a chain is at most
WINDOW words, which bounds a step's memory, not the text.

Null, repeated and odd input: a text that is null or has no letter is `und` with score 0; documents with a null lang train
nothing; without any training text all are `und`; languages tie in the order of their names; repeated rows are labelled each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_mod, documents, slices

SAMPLE, SPANS, CHAIN, WINDOW = 600, 3, 32, 128
LEXICON, SHORT = 4000, 5
STEPS, RATE, DECAY = 45, 0.25, 1e-3
#: Hash buckets of bigrams, trigrams, prefixes and suffixes, in one table.
BIGRAMS, TRIGRAMS, AFFIXES = 1 << 16, 1 << 17, 1 << 15
FEATURES = BIGRAMS + TRIGRAMS + 2 * AFFIXES
EDGES = ".,;:!?\"'()[]"
_letter = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    languages: list[str]
    lexicon: dict[str, int]  # feature number of each lexicon word
    weights: np.ndarray  # features x languages
    transitions: np.ndarray
    start: np.ndarray


def _hash(x: np.ndarray, buckets: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and the word that each belongs to, in order of the words."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    two = text[:-1] * 256 + text[1:]
    in_two = owner[:-1] == owner[1:]
    three = two[:-1] * 256 + text[2:]
    in_three = owner[:-2] == owner[2:]
    found = [two[in_two], BIGRAMS + _hash(three[in_three], TRIGRAMS)]
    owners = [owner[:-1][in_two], owner[:-2][in_three]]
    for side in (0, 1):
        code = np.zeros(len(words), np.int64)
        for k in range(1, 5):
            has = sizes - 2 >= k
            at = np.where(has, begins + k if side == 0 else ends - 1 - k, begins)
            code = code * 256 + text[at] + k
            if k > 1:
                found.append(BIGRAMS + TRIGRAMS + side * AFFIXES + _hash(code[has], AFFIXES))
                owners.append(np.flatnonzero(has))
    known = [(i, lexicon[w]) for i, w in enumerate(x.strip(EDGES) for x in words) if w in lexicon]
    if known:
        i, f = zip(*known, strict=True)
        found.append(np.array(f))
        owners.append(np.array(i))
    feature, word = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


def emissions(weights: np.ndarray, feature: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]), np.float32)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(weights[feature], first, axis=0)
    return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of each word of chains (chains x steps x labels, longest chain first), and expected transitions."""
    n, steps, labels = scores.shape
    local = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(local), np.ones_like(local)
    active = [int((sizes > t).sum()) for t in range(steps)]
    first = np.exp(start - start.max()) * local[:, 0]
    alpha[:, 0] = first / first.sum(1, keepdims=True)
    for t in range(1, steps):
        k = active[t]
        if not k:
            break
        x = alpha[:k, t - 1] @ move * local[:k, t]
        alpha[:k, t] = x / x.sum(1, keepdims=True)
    expected = np.zeros((labels, labels)) if pairs else None
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        if not k:
            continue
        ahead = local[:k, t + 1] * beta[:k, t + 1]
        if pairs:
            joint = alpha[:k, t, :, None] * move * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        x = ahead @ move.T
        beta[:k, t] = x / x.sum(1, keepdims=True)
    both = alpha * beta
    return both / np.maximum(both.sum(2, keepdims=True), 1e-30), expected


def fit(spans: list[tuple[str, list[str]]], languages: list[str], lexicon: dict[str, int], steps: int = STEPS) -> Model:
    """Maximum likelihood with a small decay, by Adam over all chains at once."""
    n_labels, n_features = len(languages), FEATURES + 1 + max(lexicon.values(), default=FEATURES - 1) - FEATURES
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(7)
    spans = [spans[i] for i in rng.permutation(len(spans))]
    chains: list[tuple[list[str], list[int]]] = []
    for i, (lang, words) in enumerate(spans):
        other_lang, other = spans[i - 1]
        if i % 2 and words and other:  # a chain that switches once or twice
            a, b = sorted(rng.integers(0, CHAIN, 2).tolist())
            parts = [(lang, words[:a]), (other_lang, other[:b - a + 1]), (lang, words[a:a + CHAIN - b])]
        else:
            parts = [(lang, words)]
        text = [w for _, p in parts for w in p]
        if text:
            chains.append((text, [number[x] for x, p in parts for _ in p]))
    chains.sort(key=lambda c: -len(c[0]))
    index: dict[str, int] = {}
    ids = [[index.setdefault(w, len(index)) for w in words] for words, _ in chains]
    sizes = np.array([len(x) for x in ids])
    width = int(sizes.max())
    word_at, label_at = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
    for i, (x, (_, y)) in enumerate(zip(ids, chains, strict=True)):
        word_at[i, :len(x)], label_at[i, :len(y)] = x, y
    real = np.arange(width) < sizes[:, None]
    gold = np.eye(n_labels, dtype=np.float32)[label_at] * real[..., None]
    follows = real[:, 1:]
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (label_at[:, :-1][follows], label_at[:, 1:][follows]), 1)
    first_seen = np.bincount(label_at[:, 0], minlength=n_labels)
    feature, word = word_features(list(index), lexicon)
    parameters = [np.zeros((n_features, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    flat_word, total = word_at[real], real.sum()
    for step in range(1, steps + 1):
        weights, transitions, start = parameters
        local = emissions(weights, feature, word, len(index))
        marginal, expected = forward_backward(local[word_at], sizes, transitions, start, True)
        wrong = (marginal * real[..., None] - gold)[real]
        by_word = np.stack([np.bincount(flat_word, wrong[:, k], len(index)) for k in range(n_labels)], 1)
        slope = [np.stack([np.bincount(feature, by_word[word, k], n_features) for k in range(n_labels)], 1), expected - seen,
                 marginal[:, 0].sum(0) - first_seen]
        for p, g, (m, v) in zip(parameters, slope, moments, strict=True):
            g = g / total + DECAY / len(p) * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)).astype(p.dtype)
    return Model(languages, lexicon, *(p.astype(np.float32) for p in parameters))


def label_texts(texts: list[str | None], model: Model) -> list[tuple[list[str], np.ndarray]]:
    """Words of each text and their marginals (words x languages)."""
    words = [(t or "").lower().split() for t in texts]
    unique = list(dict.fromkeys(w for x in words for w in x))
    labels = len(model.languages)
    if not unique:
        return [([], np.zeros((0, labels), np.float32)) for _ in texts]
    index = dict(zip(unique, range(len(unique)), strict=True))
    local = emissions(model.weights, *word_features(unique, model.lexicon), len(unique))
    flat = np.fromiter((index[w] for x in words for w in x), np.int64)
    sizes = np.array([len(x) for x in words])
    begins, lengths = [], []
    at = 0
    for n in sizes.tolist():
        for k in range(0, n, WINDOW):
            begins.append(at + k)
            lengths.append(min(WINDOW, n - k))
        at += n
    begin, length = np.array(begins), np.array(lengths)
    out = np.empty((len(flat), labels), np.float32)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), 4096):
        part = order[lo:lo + 4096]
        width = int(length[part[0]])
        place = np.minimum(begin[part, None] + np.arange(width), len(flat) - 1)
        marginal, _ = forward_backward(local[flat[place]], length[part], model.transitions, model.start)
        real = np.arange(width) < length[part, None]
        out[place[real]] = marginal[real]
    return list(zip(words, np.split(out, np.cumsum(sizes)[:-1]), strict=True))


OUT = "doc_id long, held_out boolean, lang_pred string, score double, n_switches long"


def _predict(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for b in slices(batches, "text"):
            texts, out = b.column("text").to_pylist(), []
            labelled = label_texts(texts, m) if m else [([], None)] * len(texts)
            alpha: dict[str, bool] = {}
            for text, (words, marginal) in zip(texts, labelled, strict=True):
                if m is None or not text or not _letter.search(text):
                    out.append(("und", 0.0, 0))
                    continue
                lettered = np.fromiter((alpha[w] if w in alpha else alpha.setdefault(w, bool(_letter.search(w))) for w in words), bool, len(words))
                mine = marginal[lettered]
                mean = mine.mean(0, dtype=np.float64)
                best = int(mean.argmax())
                label = mine.argmax(1)
                out.append((m.languages[best], min(1.0, float(mean[best])), int((label[1:] != label[:-1]).sum())))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *columns], [x.split()[0] for x in OUT.split(", ")])

    return run


def _short_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts[lang].update(text.lower().split())
        rows: Counter = Counter()
        for lang, found in counts.items():
            for w, n in found.items():
                w = w.strip(EDGES)
                if w and len(w) <= SHORT and w.isalpha():
                    rows[lang, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
                                          pa.array(list(rows.values()), pa.int64())], ["lang", "word", "n"])


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SPANS runs of CHAIN words of each text, evenly spread over it."""
    for b in batches:
        out = []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = text.lower().split()
            last = max(0, len(words) - CHAIN)
            for at in sorted({last * i // max(1, SPANS - 1) for i in range(SPANS)}):
                out.append((lang, words[at:at + CHAIN]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))],
                                         ["lang", "words"])


def train(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows of doc_id, text, lang; what is fetched is bounded by languages, LEXICON and `sample`."""
    rows = rows.where("lang IS NOT NULL AND length(text) > 0")
    counts = rows.select("lang", "text").mapInArrow(_short_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= LEXICON)
    tally: dict[str, dict[str, int]] = defaultdict(dict)
    for r in best.select("lang", "word", "n").toLocalIterator():
        tally[r.word][r.lang] = r.n
    picked = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("k") <= sample).select("doc_id").distinct()
    spans = [(r.lang, r.words) for r in rows.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "text").mapInArrow(
        _spans, "lang string, words array<string>").orderBy("lang", "words").toLocalIterator()]
    languages = sorted({x for x, _ in spans})
    if not languages:
        return None
    lexicon = {}
    for word, n in tally.items():
        lang = max(sorted(n), key=n.get)
        share = n[lang] / sum(n.values())
        if lang in languages:
            lexicon[word] = FEATURES + 2 * languages.index(lang) + (share >= 0.9)
    return fit(spans, languages, lexicon)


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of switches between neighbouring words, of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(plain.where(~F.col("held_out")).drop("held_out"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.select("doc_id", "text", "held_out").mapInArrow(_predict(shared), OUT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), crc_mod("doc_id", 5) == 0)
