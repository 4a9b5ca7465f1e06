"""Toxicity by a linear-chain conditional random field over words.

The chain has two states, clean and toxic. A word's score for toxic is the sum of
the weights of its features: the word, its beginnings and its ending. Weights and
transitions are fitted by gradient ascent on the likelihood of labelled words;
forward-backward gives each word's marginal, the offending offsets are the runs of
words whose marginal is a half or more, and a document's score is a logistic
function of its marginals' sum and maximum and its length.

Labels come for documents. Words are labelled from them: a word of a toxic
document counts as toxic if one of its features is tied to toxic documents beyond
chance among all features tried (by the binomial divergence from the base rate).
One half of the labelled sample labels words and fits the chain, the other half
fits the document score, weighted back to the labels' own frequencies.

The sample takes at most FIT_ROWS documents of each label, by hash order, none of
more than FIT_CHARS characters; these are the two bounds of what comes to the
driver, and nothing else is bounded. Two-state messages are log-odds; all words of
a batch update at once from their neighbours, and only those whose neighbour moved
by more than STILL go on, until none does, which gives the messages to that accuracy.

Defined results: a null text is empty; a text without words gets the score of no
marginals; without a toxic or a clean label in the sample every score is the share
of toxic labels (0 without any); null labels and labels without a document are
left out; repeated rows get equal results; an empty table gives an empty result;
columns other than id and text are never read, and `tag_rows` hands them on in one
column, so their names meet none of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.arrow import given_back, small_batches

WORD = re.compile(r"\w+")
#: Labelled documents of each label that a fit takes at most, and characters that one of them has at most.
FIT_ROWS, FIT_CHARS = 1500, 1 << 16
#: Folds, of which the first is held out.
FOLDS = 5
#: Steps and pull towards zero of the chain's fit; words that are worked on at once; words whose emission is kept.
STEPS, RIDGE, CHUNK_WORDS, CACHE_WORDS = 60, 0.02, 1 << 17, 300_000
STILL = 1e-7
SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("marginal", "double"))


def features(word: str) -> list[str]:
    return ["=" + word, word[-4:] + ">", *["<" + word[:k] for k in range(3, 9) if k < len(word)]]


def _scan(e, first, into_toxic, into_clean, at_first=0.0):
    """x[t] = e[t] + log-odds of toxic after x[t-1]; a new chain begins at `first`."""
    x = e.copy()
    x[first] += at_first
    todo = np.flatnonzero(~first)
    while len(todo):
        p = x[todo - 1]
        new = e[todo] + np.logaddexp(p + into_toxic[1], into_toxic[0]) - np.logaddexp(p + into_clean[1], into_clean[0])
        moved = np.abs(new - x[todo]) > STILL
        x[todo] = new
        todo = todo[moved] + 1
        todo = todo[todo < len(x)]
        todo = todo[~first[todo]]
    return x


def messages(e: np.ndarray, first: np.ndarray, a: np.ndarray, start: float):
    """Forward log-odds, and log-odds from the word itself onward, of each word; a[i, j]: from state i to j."""
    forward = _scan(e, first, a[:, 1], a[:, 0], start)
    last = np.append(first[1:], True) if len(first) else first
    onward = _scan(e[::-1], last[::-1], a[1, :], a[0, :])[::-1]
    return forward, onward


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Chain:
    """A fitted model: feature weights, transitions and the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray | None = None
    share: float = 0.0

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum([w[f] for f in features(word) if f in w])

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        forward, onward = messages(e, first, self.moves, self.start)
        return _sigmoid(forward + onward - e)

    def document_score(self, total, most, words):
        if self.score is None:
            return np.full(len(total), self.share)
        return _sigmoid(_document_features(total, most, words) @ self.score)


def _document_features(total, most, words):
    return np.stack([np.ones(len(total)), np.log1p(total), most, np.log1p(words)], 1)


class Emissions(dict):
    """Word to emission, worked out at first sight; emptied when full, to bound memory."""

    def __init__(self, chain: Chain, room: int = CACHE_WORDS):
        super().__init__()
        self.chain, self.room = chain, room

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = self.chain.emission(word)
        return value


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _by_document(p: np.ndarray, lengths: np.ndarray):
    """Sum and maximum of the marginals of each document."""
    total, most = np.zeros(len(lengths)), np.zeros(len(lengths))
    has = np.flatnonzero(lengths)
    if len(has):
        at = np.concatenate([[0], np.cumsum(lengths)])[has]
        total[has], most[has] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return total, most


def _starts(lengths: np.ndarray) -> np.ndarray:
    first = np.zeros(int(lengths.sum()), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return first


class Coded:
    """Documents as whole numbers: each word's type, and the features of each type.

    ids, lengths: types of all words, words of each document. types: the words
    themselves. rows, cols: pairs of a type and a feature of it; features are known
    by their 64-bit hashes, in `known`, since their texts would fill the memory.
    """

    def __init__(self, documents: Iterable[list[str]]):
        types: dict[str, int] = {}
        ids, lengths = array("q"), array("q")
        for words in documents:  # words are kept once each, as types
            ids.extend([types.setdefault(w, len(types)) for w in words])
            lengths.append(len(words))
        self.ids, self.lengths, self.types = np.array(ids, np.int64), np.array(lengths, np.int64), list(types)
        rows, hashes = array("q"), array("Q")
        for w, i in types.items():
            own = features(w)
            rows.extend([i] * len(own))
            hashes.extend(map(xxhash.xxh64_intdigest, own))
        self.rows = np.array(rows, np.int64)
        self.known, self.cols = np.unique(np.array(hashes, np.uint64), return_inverse=True)

    @property
    def words(self) -> int:
        return len(self.types)

    def named(self, telling: np.ndarray) -> list[str]:
        """The features that are marked, in the order of `known`."""
        found = {}
        for i in np.unique(self.rows[telling[self.cols]]):
            found |= {xxhash.xxh64_intdigest(f): f for f in features(self.types[i])}
        return [found[int(h)] for h in self.known[telling]]

    def holding(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs, each once."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        doc, kind = np.divmod(np.unique(doc * max(1, self.words) + self.ids), max(1, self.words))
        first = np.searchsorted(self.rows, np.arange(self.words + 1))  # rows are sorted
        count = np.diff(first)[kind]
        at = np.repeat(first[kind] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        n = max(1, len(self.known))
        return np.divmod(np.unique(np.repeat(doc, count) * n + self.cols[at]), n)


def telling_features(coded: Coded, toxic: np.ndarray) -> np.ndarray:
    """Which features are tied to toxic documents beyond chance."""
    doc, feature = coded.holding()
    n = len(coded.known)
    hits = np.bincount(feature[toxic[doc] > 0], minlength=n).astype(float)
    total = np.bincount(feature, minlength=n).astype(float)
    base = toxic.mean()
    limit = np.log(max(1, int((hits > 0).sum()))) + 3
    r = hits / np.maximum(total, 1)
    miss = np.where(r < 1, (1 - r) * np.log(np.maximum(1 - r, 1e-300) / (1 - base)), 0.0)
    tied = total * (r * np.log(np.maximum(r, 1e-300) / base) + miss) > limit
    return tied & (hits >= 3) & (r > max(0.5, base))


def fit_chain(coded: Coded, toxic: np.ndarray) -> Chain:
    """Label the words of documents and fit weights and transitions to them."""
    ids, lengths = coded.ids, coded.lengths
    if not len(ids):
        return Chain(bias=-10.0)
    telling = telling_features(coded, toxic)
    first = _starts(lengths)
    owner = np.repeat(toxic.astype(bool), lengths)
    kept = telling[coded.cols]
    place = np.cumsum(telling) - 1
    rows, cols = coded.rows[kept], place[coded.cols[kept]]
    y = (owner & (np.bincount(rows, minlength=coded.words) > 0)[ids]).astype(float)
    names = coded.named(telling)
    nf = len(names)
    theta = np.zeros(nf + 5)  # features, bias, start, moves clean-toxic, toxic-clean, toxic-toxic
    theta[nf] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(~first)
    want = np.array([[((1 - y[inner - 1]) * (1 - y[inner])).sum(), ((1 - y[inner - 1]) * y[inner]).sum()],
                     [(y[inner - 1] * (1 - y[inner])).sum(), (y[inner - 1] * y[inner]).sum()]])
    for step in range(1, STEPS + 1):
        by_type = np.bincount(rows, theta[cols], coded.words) + theta[nf]
        e = by_type[ids]
        a = np.array([[0.0, theta[nf + 2]], [theta[nf + 3], theta[nf + 4]]])
        forward, onward = messages(e, first, a, theta[nf + 1])
        p = _sigmoid(forward + onward - e)
        f, o = forward[inner - 1], onward[inner]
        joint = np.stack([np.zeros_like(f), a[0, 1] + o, f + a[1, 0], f + a[1, 1] + o])
        joint = np.exp(joint - joint.max(0))
        pair = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        gap = np.bincount(ids, y - p, coded.words)
        grad = np.concatenate([
            np.bincount(cols, gap[rows], nf), [gap.sum()], [(y - p)[first].sum()],
            [want[0, 1] - pair[0, 1], want[1, 0] - pair[1, 0], want[1, 1] - pair[1, 1]],
        ]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain({f: float(theta[i]) for i, f in enumerate(names)}, float(theta[nf]), float(theta[nf + 1]),
                 np.array([[0.0, theta[nf + 2]], [theta[nf + 3], theta[nf + 4]]]))


def _fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, pulled to zero a little."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (y - p)) - 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Chain:
    """Fit on labelled documents that aren't held out, at most `rows` of each label, none longer than `chars`."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    order = [F.xxhash64("id"), F.col("id")]
    parts = [known.where(F.col("toxic") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    # at most 2 * rows ids; an id that several rows have comes once, with the text of least hash
    sample = texts.join(F.broadcast(parts[0].union(parts[1])), "id").groupBy("id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy(*order, "toxic").collect()
    y = np.array([r["toxic"] for r in sample], dtype=float)
    if not (0 < y.sum() < len(y)):
        return Chain(share=share)
    half = np.arange(len(y)) % 2 == 0
    words = lambda mine: Coded(_words(r["text"]) for r, m in zip(sample, mine, strict=True) if m)
    chain = fit_chain(words(half), y[half])
    chain.share = share
    rest = words(~half)
    by_type = np.full(rest.words, chain.bias)
    weights = np.zeros(len(rest.known))
    for f, w in chain.weights.items():
        weights[rest.known == np.uint64(xxhash.xxh64_intdigest(f))] = w
    by_type += np.bincount(rest.rows, weights[rest.cols], rest.words) if len(weights) else 0.0
    total, most = _by_document(chain.marginals(by_type[rest.ids], _starts(rest.lengths)), rest.lengths)
    yy = y[~half]
    part = max(1e-9, yy.mean())
    weight = np.where(yy == 1, share / part, (1 - share) / max(1e-9, 1 - part))
    chain.score = _fit_score(_document_features(total, most, rest.lengths), yy, weight)
    return chain


def _tagged(chain: Chain, cache: Emissions, texts: list[str]) -> tuple[np.ndarray, list]:
    """Score and spans of each text, CHUNK_WORDS words or one text at a time."""
    scores, spans, at = [], [], 0
    while at < len(texts):
        words, lengths, begin = [], [], at
        while at < len(texts) and len(words) < CHUNK_WORDS:
            own = _words(texts[at])
            words += own
            lengths.append(len(own))
            at += 1
        lengths = np.array(lengths, np.int64)
        p = chain.marginals(np.fromiter(map(cache.__getitem__, words), float, len(words)), _starts(lengths))
        total, most = _by_document(p, lengths)
        ends = np.cumsum(lengths)
        spans += [_spans(texts[begin + i], p[ends[i] - lengths[i] : ends[i]]) if most[i] >= 0.5 else [] for i in range(len(lengths))]
        scores.append(chain.document_score(total, most, lengths))
    return np.concatenate(scores), spans


def tagger(spark: SparkSession, chain: Chain):
    """A column function: text to (score, spans), in Arrow batches; spans are (start, end, marginal) of offending word runs, in characters."""
    model = spark.sparkContext.broadcast(chain)
    found = T.StructType().add("score", "double").add("spans", SPANS)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    @given_back
    def tagged(batches):
        chain = model.value
        cache = Emissions(chain)
        for batch in batches:
            scores, spans = _tagged(chain, cache, [t or "" for t in batch.to_pylist()]) if len(batch) else (np.empty(0), [])
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(spans, span)], names=["score", "spans"])

    @F.arrow_udf(found)
    def tag_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tagged(batches)

    return tag_texts.asNondeterministic()  # else a filter on the score would run it a second time


def tag_rows(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Rows (row, score, spans): each row of `docs` as a struct, with its score and offending spans.

    Only texts go to Python, and only scores and spans come back.
    """
    tag_texts = tagger(docs.sparkSession, chain)
    tagged = small_batches(docs).select(F.struct(*docs.columns).alias("row"), tag_texts(F.col(text_col)).alias("found"))
    return tagged.select("row", "found.score", "found.spans")


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, spans), one for each row of `docs`."""
    tagged = tag_rows(docs.select(id_col, text_col), chain, text_col)
    return tagged.select(F.col(f"row.{id_col}").alias(id_col), "score", "spans")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words with a marginal of a half or more; the words are those of the lowered text."""
    lowered = text.lower()
    places = [m.span() for m in WORD.finditer(text if len(text) == len(lowered) else lowered)]
    if len(places) != len(p):
        places = [m.span() for m in WORD.finditer(lowered)]
    runs: list[dict] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5):
        if i == last + 1:
            runs[-1]["end"] = places[i][1]
            runs[-1]["marginal"] = max(runs[-1]["marginal"], float(p[i]))
        else:
            runs.append({"start": places[i][0], "end": places[i][1], "marginal": float(p[i])})
        last = i
    return runs


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of the tags: one row for each document."""
    scored = tag(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )
