"""Abusive, hateful or sexual content: multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's score is a logistic function of hashed character n-grams of its folded spelling,
a document's score is the noisy-or of its sentences, 1 - prod(1 - p), and the weights are trained from document labels alone.
The trained sentence scores then point at the offending sentences.

A long text has many clean sentences with a small score each. What clean sentences score, the leak, is measured after training
and taken out of every sentence before the noisy-or, q = (p - leak) / (1 - leak), so length alone adds up to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the classifier is fitted on, chosen by hash, and the characters of text they may have together (a document
#: that no longer fits is passed over); the only bounds in this module.
MAX_LABELLED, MAX_CHARS = 20_000, 16_000_000
#: Hashed feature space and n-gram lengths.
BITS, GRAMS = 18, (3, 4, 5, 6)
#: A sentence without a break is cut into stretches of about this many characters.
STRETCH = 160
#: A document offends from this noisy-or on, and a sentence from this score on (raters' errors keep even plain cases well below 1).
THRESHOLD = 0.4
#: The leak is this quantile of the sentence scores in documents held to be clean.
LEAK_QUANTILE = 0.99

#: Letters that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁԛԝαβεηικνορτυχγ", "abekmhopctyxijsdqwabenikvoptuxy")
#: Signs read as letters inside a word (fixed values).
SIGNS = str.maketrans("0134578@$!|€£", "oieastbasiiel")

#: Names of elements that texts are marked up with; any name with a prefix (jats:p, mml:mi) is one too.
ELEMENTS = (
    "a abbr abstract article aside b bdi bdo blockquote body bold br caption center cite code col dd del details dfn disp-formula disp-quote div dl dt em ext-link fig figure figcaption fn "
    "font footer h1 h2 h3 h4 h5 h6 head header hr html i img inf inline-formula ins italic kbd label li link list list-item main mark math meta mfrac mi mn mo monospace mover mrow ms "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder nav nobr ol p pre q ref roman s samp sc script sec section small span strike strong style sub summary sup svg table tbody td "
    "tex-math tfoot th thead title tr tt u ul underline var xref"
).split()
# a comparison sign opens no tag: what isn't an element with attributes stays in the text and is scored
_TAG = re.compile(
    r"</?(?:[a-z][\w.-]*:[a-z][\w.-]*|" + "|".join(map(re.escape, ELEMENTS)) + r""")(?:\s+[a-z_][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*\s*/?>|&[a-z]{2,8};|&#\d{1,6};""",
    re.IGNORECASE,
)
_END = re.compile(r"(?<=[.!?…])(?:(?<=[^\s.][^\s.].)|(?<=[\d)].))[\"'’”»)]*\s+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿]")
_BROKEN_LINE = re.compile(r"(?<=[a-z])-\s*\n\s*(?=[a-z])")
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][\s._*\-·]{1,3}){2,}[^\W_](?![^\W_])")
_MASKED = re.compile(r"(?<!\w)([^\W\d_]?)[*#]{2,}([^\W\d_]*)")
_INNER = re.compile(r"(?<=[^\W\d_])[._*\-·’'+~^]+(?=[^\W\d_])")
_SIGN = re.compile(r"[0-9@$!|€£]")
_WORD = r"\s.,;:?()\[\]\"“”«»<>=/"
_MIXED = re.compile(rf"(?<![^{_WORD}])[^{_WORD}0-9@$!|€£]*+[0-9@$!|€£][^{_WORD}]*")
#: What remains of a folded sentence: letters, digits as 0, anything else as a blank.
_SHOWN = np.full(256, ord(" "), np.uint8)
_SHOWN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SHOWN[ord("0") : ord("9") + 1] = ord("0")


class _Bare(dict):
    """Characters without accents, lookalikes as letters."""

    def __missing__(self, code: int) -> int | None:
        bare = self[code] = None if unicodedata.combining(chr(code)) else LOOKALIKES.get(code, code)
        return bare


_BARE = _Bare()


def sentences(text: str) -> list[str]:
    """The sentences of a text without its markup; stretches without a break are cut at white space."""
    out = []
    for s in _END.split(_TAG.sub(" ", text) if "<" in text or "&" in text else text):
        s = s.strip()
        while len(s) > 2 * STRETCH:
            at = s.rfind(" ", STRETCH // 2, STRETCH)
            at = at if at > 0 else STRETCH
            out.append(s[:at])
            s = s[at:].strip()
        if s:
            out.append(s)
    return out


def _unsign(m: re.Match) -> str:
    word = m.group()
    letters = sum(c.isalpha() for c in word)
    if not letters or (letters < 2 and len(word) > 3):
        return word
    core = word.rstrip("!")
    return core.translate(SIGNS)


def _spell(sentence: str) -> str:
    """Lower case without accents, lookalikes and signs read as letters, spelt-out words joined."""
    if sentence.isascii():
        s = sentence.lower()
    else:
        s = _HIDDEN.sub("", unicodedata.normalize("NFKC", sentence)).lower()
        s = re.sub(r"\d", "0", unicodedata.normalize("NFD", s).translate(_BARE).replace("ß", "ss"))
    if "\n" in s:
        s = _BROKEN_LINE.sub("", s)
    if "*" in s or "#" in s:
        s = _MASKED.sub(r" \1zxqz\2 ", s)
    s = _SPELT.sub(lambda m: re.sub(r"[\W_]+", "", m.group()), s)
    s = _INNER.sub("", s)
    return _MIXED.sub(_unsign, s) if _SIGN.search(s) else s


def letters(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded sentences as bytes one after another, and the length of each.

    One spelling for many: see :func:`_spell`; then letters repeated three times or more are reduced to one, digits to one 0, and
    everything else to single blanks, with a blank at either end.
    """
    raw = [b" " + _spell(s).encode("ascii", "replace") + b" " for s in sentences]
    row = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter(map(len, raw), np.int64, len(raw)))
    text = _SHOWN[np.frombuffer(b"".join(raw), np.uint8)]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    run, sign = np.diff(np.append(at, len(text))), text[at]
    times = np.where((sign > ord("9")) & (run < 3), run, 1)
    return np.repeat(sign, times), np.bincount(np.repeat(row[at], times), minlength=len(raw))


def fold(sentence: str) -> str:
    """The folded spelling of one sentence."""
    return letters([sentence])[0].tobytes().decode()


#: The feature number of what is no feature: an n-gram that would run beyond its sentence. Its weight stays 0.
NONE = 1 << BITS


def features(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, a row for each n-gram length and a column for each character it starts at, and every sentence's number of them."""
    left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))).astype(np.int32)
    out = np.full((len(GRAMS), len(text)), NONE, np.int32)
    h, codes = np.zeros(len(text), np.uint32), text.astype(np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        h[:m] *= np.uint32(0x01000193)
        h[:m] += codes[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out[GRAMS.index(n)] = np.where(left >= n, mixed >> np.uint32(32 - BITS), NONE)
    return out, sum(np.maximum(lengths - n + 1, 0) for n in GRAMS)


def logits(weights: np.ndarray, bias: float, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sentence logits: the bias and the weights' sum over the root of the number of features."""
    index, counts = features(text, lengths)
    return _logits(weights, bias, index, lengths, 1 / np.sqrt(np.maximum(counts, 1)))


def _logits(weights: np.ndarray, bias: float, index: np.ndarray, lengths: np.ndarray, scale: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.empty(0)
    total = np.zeros(index.shape[1])
    for row in index:
        total += weights[row]
    return bias + np.add.reduceat(total, np.cumsum(lengths) - lengths) * scale


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0.0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(z: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Bag scores of consecutive sentences; an empty bag scores 0."""
    return -np.expm1(_sums(-np.logaddexp(0, np.clip(z, -30, 30)), bags))


def document_scores(z: np.ndarray, bags: np.ndarray, leak: float) -> np.ndarray:
    """Noisy-or of consecutive sentences over what each scores beyond the leak; an empty bag scores 0."""
    q = np.clip((_probability(z) - leak) / (1 - leak), 0, 1 - 1e-12)
    return -np.expm1(_sums(np.log1p(-q), bags))


@dataclass
class Model:
    """Weights (the last, of no feature, is 0), bias, the number of labelled documents they come from, and the leak."""

    weights: np.ndarray
    bias: float
    n_labelled: int
    leak: float = 0.0


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 60, rate: float = 2.0, seed: int = 7) -> Model:
    """Train sentence weights from soft document labels by mini-batches of the noisy-or likelihood (AdaGrad).

    Every epoch goes over all documents. Raters err: from a third of the epochs on, at every sixth, a label that the model holds to
    be wrong with near certainty is left out, or turned round if the document was labelled clean.
    """
    weights, bias = np.zeros(NONE + 1, np.float32), -4.0
    if not len(texts):
        return Model(weights, -30.0, 0)
    parts = [sentences(t) for t in texts]
    bags = np.array([len(p) for p in parts])
    text, lengths = letters([s for p in parts for s in p])
    index, counts = features(text, lengths)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    s_at = np.concatenate([[0], np.cumsum(bags)])
    c_at = np.concatenate([[0], np.cumsum(lengths)])[s_at]
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    squares, bias_square = np.full(NONE + 1, 1e-2, np.float32), 1e-2
    seen = np.full(len(y), 0.5)
    trusted = np.ones(len(y), bool)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            at = np.concatenate([np.arange(s_at[i], s_at[i + 1]) for i in own])
            flat = np.concatenate([index[:, c_at[i] : c_at[i + 1]] for i in own], axis=1).astype(np.int64)
            size, n, by = bags[own], lengths[at], scale[at]
            z = _logits(weights, bias, flat, n, by)
            p, whole = _probability(z), np.maximum(noisy_or(z, size), 1e-9)
            seen[own] = whole
            slope = np.repeat(np.where(trusted[own], (whole - y[own]) / whole, 0), size) * p / 64
            g = np.bincount(flat.ravel(), np.tile(np.repeat(slope * by, n), len(GRAMS)), NONE + 1).astype(np.float32)
            g[NONE] = 0
            squares += g * g
            weights -= np.float32(rate) * g / np.sqrt(squares)
            gb = slope.sum()
            bias_square += gb * gb
            bias -= 0.1 * gb / np.sqrt(bias_square)
        if epoch >= epochs // 3 and epoch % 6 == 0:
            y = np.where((y < 0.5) & (seen > 0.95), 1.0, y)
            trusted = (np.abs(seen - y) < 0.9) | (y < 0.5)
    clean = _probability(_logits(weights, bias, index, lengths, scale))[np.repeat(y < 0.5, bags)]
    return Model(weights, float(bias), len(texts), float(np.quantile(clean, LEAK_QUANTILE)) if len(clean) else 0.0)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and mean labels of at most ``most`` labelled documents, the least by hash of the id, with at most ``chars`` characters.

    The ids are chosen first, then the lengths of their texts are looked at, and only texts that fit are fetched, whole.
    """
    means = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    chosen = F.broadcast(means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # `most` rows of two numbers
    held = docs.select("doc_id", "text").join(chosen, "doc_id").filter("length(text) > 0")
    sizes = held.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    ids, total = [], 0
    for i, n in zip(sizes["doc_id"].to_pylist(), sizes["n"].to_pylist()):
        if total + n <= chars:
            ids.append((i,))
            total += n
    fitting = F.broadcast(docs.sparkSession.createDataFrame(ids, docs.select("doc_id").schema))
    rows = held.join(fitting, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "y").toArrow()
    return rows["text"].to_pylist(), np.asarray(rows["y"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The classifier for these labels; without usable labels every score is near 0."""
    return fit(*labelled(docs, labels, most))


def score(docs: DataFrame, model: Model, *, keep: list[str] = ("doc_id",), located: bool = False) -> DataFrame:
    """``keep`` with ``score`` in [0, 1], the noisy-or beyond the leak, ``worst``, the greatest sentence score, and, if ``located``, ``offending``: an array of
    (sentence, score, text) of the sentences from ``THRESHOLD`` on, in a document whose score is from there on at least of its worst one. One row
    per input row, no shuffle.

    Defined cases: null, empty and contentless texts score 0 and have a worst sentence of 0; texts of any length are scored whole; repeated rows stay; an
    empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))  # 2^18 floats
    names = [*keep, "score", "worst", *(["offending"] if located else [])]
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, leak = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                parts = [sentences(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
                flat = [s for p in parts for s in p]
                bags = np.array([len(p) for p in parts], np.int64)
                zs = [np.empty(0)]
                for k in range(0, len(flat), 5_000):
                    zs.append(logits(weights, bias, *letters(flat[k : k + 5_000])))
                z = np.concatenate(zs)
                p, ends = _probability(z), np.concatenate([[0], np.cumsum(bags)])
                worst = np.zeros(len(bags))
                np.maximum.at(worst, np.repeat(np.arange(len(bags)), bags), p)
                scores = document_scores(z, bags, leak)
                cols = [*batch.columns[:-1], pa.array(scores), pa.array(worst)]
                if located:
                    least = np.where(scores >= THRESHOLD, np.minimum(worst, THRESHOLD), THRESHOLD).tolist()
                    hits = [[{"sentence": i - s, "score": float(p[i]), "text": flat[i]} for i in range(s, e) if p[i] >= t] for s, e, t in zip(ends[:-1].tolist(), ends[1:].tolist(), least)]
                    cols.append(pa.array(hits, kind))
                yield pa.RecordBatch.from_arrays(cols, names)

    types = dict(docs.dtypes)
    extra = ["score double", "worst double", *(["offending array<struct<sentence:int,score:double,text:string>>"] if located else [])]
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *extra]))
