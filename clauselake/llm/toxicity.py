"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: in the fitting documents a word is toxic where it is in a toxic
document and belongs to the words whose distinct contexts (neighbouring words) are far more frequent there than in
clean documents; near copies share their contexts and so count once. The field has two states. A token's emission is
the sum of learned weights of its letters, its first five, first three and last three letters and its shape; transitions are learned.
Forward-backward marginals of the whole document give the probability of every token to be toxic. Their highest value,
sum and share become a document score by a logistic model, and runs of likely tokens become spans.

The fit uses a bounded sample: at most ``TOXIC`` toxic and ``CLEAN`` clean labelled documents outside the held-out
fold, chosen by the hash of their id, with texts of at most ``CHARACTERS`` characters. The model is a few thousand
weights. Scoring reads whole texts and nothing but the text.

Cases: a null or blank text has no tokens and gets the score of none; rows with a null doc_id are scored and not held
out; a document labelled twice counts as toxic when any label says so; null labels are ignored; without toxic or
without clean labels every score is 0; repeated rows are scored alike; an empty table gives an empty result; all other
columns are kept by ``score``.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.llm.common import bounded, fresh_name, in_fold, map_batches

#: documents of the fitting sample, and their characters at most
TOXIC, CLEAN, CHARACTERS = 400, 800, 40_000
THRESHOLD = 0.7
#: contexts a toxic word needs, at least and as a share of the toxic documents, and how many times more frequent
#: they are in toxic documents
LEAST_CONTEXTS, LEAST_SHARE, LEAST_RATIO = 7, 0.012, 8.0
#: fitting rounds of the field and of the document model, and fitting tokens a feature needs
ROUNDS, LOGISTIC_ROUNDS, LEAST_TOKENS = 30, 400, 5
#: steps of one block of the scan, and texts scored together by their bytes
STEPS, GROUP_BYTES = 128, 3 << 20


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    logistic: np.ndarray | None = None  # weights of the document model, intercept last; None: no model


def features(word: str) -> list[str]:
    letters = "".join(filter(str.isalpha, word)).lower()
    shape = ("u" if word.isupper() else "") + ("" if word.isalpha() else "x")
    return [f"w{letters}", f"q{letters[:5]}", f"p{letters[:3]}", f"s{letters[-3:]}", f"h{shape}"]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the token codes of all texts, and per text its first token (n + 1 entries)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    kept = filled[code] if len(code) else np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(each)])
    return coded.dictionary, code[kept], np.concatenate([[0], np.cumsum(kept)])[first]


def _scan(first: np.ndarray, odds: np.ndarray, a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages (n, 2) of one stream in which ``first`` marks the starts of chains.

    The stream is cut into blocks. The product of a block's 2 x 2 steps carries messages over it, then all blocks
    are run side by side from their exact incoming messages.
    """
    n = len(odds)
    blocks = -(-n // STEPS)
    shape = (STEPS, blocks)
    fill = np.ones(blocks * STEPS - n)
    e = np.concatenate([odds, fill]).reshape(blocks, STEPS).T.copy()
    s = np.concatenate([first, fill > 0]).reshape(blocks, STEPS).T.copy()
    # a step's matrix; at a chain's start both rows are the same, which forgets the past
    m = [np.where(s, start[j], a[i, j]) * (e if j else 1.0) for i in (0, 1) for j in (0, 1)]
    p = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for t in range(STEPS):
        p = [p[0] * m[0][t] + p[1] * m[2][t], p[0] * m[1][t] + p[1] * m[3][t], p[2] * m[0][t] + p[3] * m[2][t], p[2] * m[1][t] + p[3] * m[3][t]]
        scale = 1.0 / (p[0] + p[1] + p[2] + p[3])
        p = [x * scale for x in p]
    rows = list(zip(*(x.tolist() for x in p), strict=True))
    into, x, y = [], 0.5, 0.5
    for q in rows:
        into.append((x, y))
        x, y = x * q[0] + y * q[2], x * q[1] + y * q[3]
        x, y = x / (x + y), y / (x + y)
    back, x, y = [], 0.5, 0.5
    for q in reversed(rows):
        back.append((x, y))
        x, y = q[0] * x + q[1] * y, q[2] * x + q[3] * y
        x, y = x / (x + y), y / (x + y)
    forward, backward = np.empty((2, *shape)), np.empty((2, *shape))
    x, y = np.array(into).T
    for t in range(STEPS):
        x, y = x * m[0][t] + y * m[2][t], x * m[1][t] + y * m[3][t]
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
        forward[0, t], forward[1, t] = x, y
    x, y = np.array(back[::-1]).T
    for t in range(STEPS - 1, -1, -1):
        backward[0, t], backward[1, t] = x, y
        x, y = m[0][t] * x + m[1][t] * y, m[2][t] * x + m[3][t] * y
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
    flat = lambda z: z.transpose(2, 1, 0).reshape(-1, 2)[:n]
    return flat(forward), flat(backward)


def messages(scores: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages and the probability of each token to be toxic."""
    if not len(scores):
        return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)
    marks = np.zeros(len(scores), bool)
    marks[first[:-1][np.diff(first) > 0]] = True
    odds = np.exp(np.clip(scores, -30, 30))
    f, b = _scan(marks, odds, np.exp(model.transitions), np.exp(model.start))
    joint = f * b
    return f, b, joint[:, 1] / joint.sum(axis=1)


def expected_steps(scores: np.ndarray, f: np.ndarray, b: np.ndarray, inner: np.ndarray, transitions: np.ndarray, run: int = 1 << 16) -> np.ndarray:
    """Expected counts of the four transitions into the tokens ``inner``."""
    total = np.zeros((2, 2))
    for at in range(0, len(inner), run):
        k = inner[at : at + run]
        after = b[k] * np.stack([np.ones(len(k)), np.exp(np.clip(scores[k], -30, 30))], axis=1)
        step = f[k - 1][:, :, None] * np.exp(transitions)[None] * after[:, None, :]
        total += (step / step.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return total


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: highest marginal, log of one plus their sum, and their share of the tokens."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    some = n > 0
    if some.any():
        heads = first[:-1][some]
        total = np.add.reduceat(p, heads)
        out[some] = np.stack([np.maximum.reduceat(p, heads), np.log1p(total), total / n[some]], axis=1)
    return out


def emissions(words: pa.Array, model: Model) -> np.ndarray:
    get, bias = model.weights.get, model.bias
    return np.array([bias + sum(get(f, 0.0) for f in features(w)) for w in words.to_pylist()], float)


def toxic_words(words: list[str], code: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Letters of the words whose distinct contexts are far more frequent in toxic texts."""
    letters = ["".join(filter(str.isalpha, w)).lower() for w in words]
    numbered = {w: i for i, w in enumerate(dict.fromkeys(letters))}
    core = np.array([numbered[w] for w in letters], np.int64)[code]
    owner = np.repeat(toxic, np.diff(first))
    ends = np.zeros(len(core) + 1, bool)
    ends[first] = True
    before = np.where(ends[:-1], -1, np.concatenate([[-1], core[:-1]]))
    after = np.where(ends[1:], -1, np.concatenate([core[1:], [-1]]))
    counts, sizes = [], []
    for y in (True, False):
        seen = np.unique(np.stack([core, before, after], axis=1)[owner == y], axis=0)
        counts.append(np.bincount(seen[:, 0], minlength=len(numbered)))
        sizes.append(max(1, len(seen)))
    ratio = (counts[0] + 0.5) / sizes[0] / ((counts[1] + 0.5) / sizes[1])
    chosen = np.flatnonzero((counts[0] >= max(LEAST_CONTEXTS, LEAST_SHARE * toxic.sum())) & (ratio >= LEAST_RATIO))
    names = list(numbered)
    return {names[i] for i in chosen if names[i]}


def fit_texts(texts: list[str], toxic: np.ndarray, sizes: tuple[int, int]) -> Model:
    """Fit on texts with document labels; ``sizes``: all labelled toxic and clean documents, for the prior."""
    if not toxic.any() or toxic.all():
        return Model()
    words, code, first = split(pa.array(texts, pa.large_string()))
    names = words.to_pylist()
    bad = toxic_words(names, code, first, toxic)
    is_bad = np.array(["".join(filter(str.isalpha, w)).lower() in bad for w in names], bool)
    y = is_bad[code] & np.repeat(toxic, np.diff(first))

    count = np.bincount(code, minlength=len(names))
    tokens_of: dict[str, int] = defaultdict(int)
    each = [features(w) for w in names]
    for fs, c in zip(each, count.tolist(), strict=True):
        for f in fs:
            tokens_of[f] += c
    number = {f: i for i, f in enumerate(f for f, c in tokens_of.items() if c >= LEAST_TOKENS)}
    table = np.array([[number.get(f, len(number)) for f in fs] for fs in each], np.int64)
    del each, tokens_of, is_bad
    weights, seen = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
    model = Model(bias=-4.0)
    marks = np.zeros(len(code), bool)
    marks[first[:-1][np.diff(first) > 0]] = True
    inner = np.flatnonzero(~marks)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[inner - 1].astype(int), y[inner].astype(int)), 1.0)
    small = np.zeros(7)  # squared gradients of bias, transitions and start
    scale = 1.0 / max(1, y.sum())
    for _ in range(ROUNDS):
        weights[-1] = 0
        score = model.bias + weights[table].sum(axis=1)
        f, b, p = messages(score[code], first, model)
        off = (y - p) * scale
        by_word = np.bincount(code, off, len(names))
        gradient = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), len(weights)) - 1e-4 * weights
        seen += gradient**2
        weights += 0.7 * gradient / np.sqrt(seen + 1e-12)
        expected = expected_steps(score[code], f, b, inner, model.transitions)
        rest = np.concatenate([[off.sum()], ((observed - expected) * scale).ravel(), np.bincount(y[marks], minlength=2)[:2] * scale])
        rest[5:] -= np.array([(1 - p[marks]).sum(), p[marks].sum()]) * scale
        small += rest**2
        rest = 0.3 * rest / np.sqrt(small + 1e-12)
        model.bias += rest[0]
        model.transitions = model.transitions + rest[1:5].reshape(2, 2)
        model.start = model.start + rest[5:]
    weights[-1] = 0
    model.weights = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 0.01}

    x = summary(messages(emissions(words, model)[code], first, model)[2], first)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(toxic, sizes[0] / toxic.sum(), sizes[1] / (~toxic).sum())
    share = share / share.sum()
    w = np.zeros(4)
    for _ in range(LOGISTIC_ROUNDS):  # Newton steps with a weak prior
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (toxic - q)) - 1e-4 * w
        curve = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(4)
        move = np.linalg.solve(curve, gradient)
        w = w + move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    model.logistic = w
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~in_fold(F.col("doc_id"), 3))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = texts.filter(F.length("text") <= CHARACTERS)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(f"toxic = {y}").orderBy(*order).limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    chosen = chosen[0].unionByName(chosen[1])  # no more than TOXIC + CLEAN rows
    prior = (sizes.get(1, 0), sizes.get(0, 0))

    def fit_sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        m = fit_texts([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.weights, m.bias, m.transitions, m.start, m.logistic))], pa.binary())], ["model"])

    # the bounded sample is fitted by one task, which leaves the driver's memory alone
    sample = short.join(F.broadcast(chosen), "doc_id").distinct().limit(2 * (TOXIC + CLEAN))
    fitted = sample.repartition(1).mapInArrow(fit_sample, "model binary").first()
    return Model(*pickle.loads(bytes(fitted[0]))) if fitted else Model()


def score_texts(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores and toxic spans (first and last + 1 character, highest marginal) of some texts."""
    if model.logistic is None:
        return np.zeros(len(texts)), [[] for _ in range(len(texts))]
    words, code, first = split(texts)
    p = messages(emissions(words, model)[code] if len(code) else np.zeros(0), first, model)[2]
    x = np.concatenate([summary(p, first), np.ones((len(texts), 1))], axis=1)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
    hot = np.flatnonzero(p >= 0.5)
    for d in np.unique(np.searchsorted(first, hot, side="right") - 1).tolist():
        text, at = texts[d].as_py(), 0
        own = words.take(pa.array(code[first[d] : first[d + 1]])).to_pylist()
        last = -2
        for k, (word, q) in enumerate(zip(own, p[first[d] : first[d + 1]].tolist(), strict=True)):
            at = text.index(word, at)
            if q >= 0.5:
                if k == last + 1:
                    spans[d][-1] = (spans[d][-1][0], at + len(word), max(q, spans[d][-1][2]))
                else:
                    spans[d].append((at, at + len(word), q))
                last = k
            at += len(word)
    return 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30))), spans


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, and behind them ``toxicity`` (double) and ``toxic_spans`` of the whole text.

    Where the table has columns of these names, the new ones get underscores behind theirs.
    """
    names, new = docs.columns, [fresh_name(docs, "toxicity"), fresh_name(docs, "toxic_spans")]
    at = names.index("text")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([*docs.schema, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for part in bounded(batch, at, GROUP_BYTES):
                value, spans = score_texts(part.column(at), model)
                found = pa.array([[{"start": s, "end": e, "probability": q} for s, e, q in x] for x in spans], arrow)
                yield [*part.columns, pa.array(value), found]

    return map_batches(docs, run, schema)


def predicted(score_column: str = "toxicity", value: float = THRESHOLD) -> Column:
    """1 where the score reaches the threshold."""
    return (F.col(score_column) >= value).cast("int")
