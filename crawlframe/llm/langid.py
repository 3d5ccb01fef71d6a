"""Language identification (operator 5): averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear layer and softmax follow.
Both are trained by stochastic gradient descent in numpy on a bounded sample. Temperature and rejection threshold are
calibrated on a part of the sample that training leaves out: the threshold lies between the scores of those texts, whole and in
stretches, and the scores of the same texts with every letter put in the place of another. For prediction the two matrices are multiplied
once, so a text costs one table look-up for each n-gram.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import only

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Signs that are looked up at a time; each takes some 60 bytes and three rows of the table, so this bounds a worker's memory.
GROUP = 1 << 17


@dataclass(frozen=True)
class Settings:
    #: Bound of the training sample: rows for each language, taken by the order of a hash.
    rows_per_lang: int = 400
    dim: int = 16
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7
    #: Shares of calibration texts, and of the same in scrambled letters, that the threshold may turn away and let pass.
    false_rejects: float = 0.001
    false_passes: float = 0.01
    #: Texts in two languages and short ones may score little, so only a score up to this many times that of chance is turned away.
    over_chance: float = 1.2


def windows(text: str):
    """(part, number of places) of a text in lower case between two spaces: every n-gram begins at a place of one part."""
    whole = f" {text.lower()} "
    for at in range(0, len(whole), GROUP):
        yield whole[at : at + GROUP + max(ORDERS) - 1], min(GROUP, len(whole) - at)


def grams(parts: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each part); n-grams begin at the first ``places`` signs of a part."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    place = np.arange(len(cp)) - np.repeat(ends - sizes, sizes)
    room = np.where(place < np.repeat(places, sizes), np.repeat(sizes, sizes) - place, 0)  # signs up to the end of the part
    h, columns, masks = np.zeros(len(cp), np.uint32), [], []
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(cp), np.uint32)
        shifted[: len(cp) - n + 1] = cp[n - 1 :]
        h = (h * np.uint32(0x01000193)) ^ (shifted * np.uint32(0x9E3779B1))
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            columns.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
            masks.append(room >= n)
    ids = np.stack(columns, 1)
    mask = np.stack(masks, 1)
    counts = np.add.reduceat(mask.sum(1), ends - sizes) if len(cp) else np.zeros(0, np.int64)
    return ids[mask], counts


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, and the share of each."""
    ids = np.concatenate([grams([part], [n])[0] for part, n in windows(text)])
    values, counts = np.unique(ids, return_counts=True)
    return values, (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages, with the bias in every row, and a column that is 1 for buckets met in training
    temperature: float = 1.0
    #: Least score, and least share of n-grams met in training, of a text that isn't rejected.
    threshold: float = 0.0
    support: float = 0.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each text (not empty) for each language, and the share of its n-grams met in training."""
        means = self.means(texts)
        return _softmax(means[:, :-1] / self.temperature), means[:, -1]

    def means(self, texts: list[str]) -> np.ndarray:
        """Means of table rows; texts share look-ups, and long ones go window by window."""
        total, count = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), np.int64)
        pieces = ((i, part, n) for i, t in enumerate(texts) for part, n in windows(t))
        for group in _groups(pieces, GROUP):
            owners, parts, places = zip(*group)
            ids, counts = grams(list(parts), list(places))
            sums = np.add.reduceat(self.table[ids], np.cumsum(counts) - counts, axis=0)
            np.add.at(total, list(owners), sums)
            np.add.at(count, list(owners), counts)
        return total / count[:, None]

    def rejected(self, scores: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return (scores < self.threshold) | (shares < self.support)


def _groups(pieces, limit: int):
    group, size = [], 0
    for piece in pieces:
        if group and size + len(piece[1]) > limit:
            yield group
            group, size = [], 0
        group.append(piece)
        size += len(piece[1])
    if group:
        yield group


def _stretches(text: str, rng: np.random.Generator) -> list[str]:
    """A text and short stretches of it, as short texts also come."""
    out = [text]
    for size in (20, 60, 200):
        if len(text) > size:
            at = int(rng.integers(0, len(text) - size))
            out.append(text[at : at + size])
    return out


def _scrambled(text: str, rng: np.random.Generator) -> str:
    """The text in lower case with each of its letters in the place of another: no language, but words and lengths as they come."""
    letters = sorted({c for c in text.lower() if c.isalpha()})
    return text.lower().translate(dict(zip(map(ord, letters), rng.permutation(letters).tolist()))) if letters else text


def _limit(clean: np.ndarray, foreign: np.ndarray, settings: Settings) -> float:
    """A limit above what most foreign texts reach, but a tenth below what all but a few clean ones do."""
    return float(min(0.9 * np.quantile(clean, settings.false_rejects), np.quantile(foreign, 1 - settings.false_passes)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model | None:
    """Fit a model; None if there is nothing to learn from. Same rows in the same order give the same model."""
    kinds = sorted(set(langs))
    if not kinds:
        return None
    rng = np.random.default_rng(settings.seed)
    y = np.array([kinds.index(x) for x in langs])
    held = np.arange(len(texts)) % 5 == 4
    if held.all() or not held.any():
        held[:] = False
    bags, labels = [], []
    for k in np.flatnonzero(~held):
        for part in _stretches(texts[k], rng):
            bags.append(bag(part))
            labels.append(y[k])
    emb = rng.normal(0, 0.1, (BUCKETS, settings.dim)).astype(np.float32)
    out = np.zeros((settings.dim, len(kinds)), np.float32)
    bias = np.zeros(len(kinds), np.float32)
    step, total = 0, settings.epochs * len(bags)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(bags)):
            values, weights = bags[k]
            rate = settings.rate * (1 - step / total)
            step += 1
            mean = weights @ emb[values]
            p = _softmax(mean @ out + bias)
            p[labels[k]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            emb[values] -= (rate * 10) * weights[:, None] * back
    met = np.zeros((BUCKETS, 1), bool)
    for values, _ in bags:
        met[values] = True
    model = Model(kinds, np.hstack([np.where(met, emb @ out, 0) + bias, met]).astype(np.float64))
    if held.any():
        own, truth = zip(*((part, y[k]) for k in np.flatnonzero(held) for part in _stretches(texts[k], rng) if any(map(str.isalpha, part))))
        logits = model.means(own)[:, :-1]
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(own)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 8, 61)}
        model.temperature = float(min(losses, key=losses.get))
        clean = [x if k else x.max(1) for k, x in enumerate(model.scores(own))]
        foreign = [x if k else x.max(1) for k, x in enumerate(model.scores([_scrambled(t, rng) for t in own]))]
        model.threshold, model.support = (_limit(a, b, settings) for a, b in zip(clean, foreign))
        model.threshold = min(model.threshold, settings.over_chance / len(kinds))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(text, lang, _nth) of the training sample: labelled rows with a letter, outside the held-out third, the same for any order of rows.

    The number of rows of each language, of which there are as many as the model has columns, gives a limit of the hash below which about
    twice as many lie as are taken, so tasks hand on few rows however many there are. Of equal rows each one counts.
    """
    rows = only(docs, "doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    shares = {r.lang: 2 * settings.rows_per_lang / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect() if r.n > 4 * settings.rows_per_lang}
    limits = F.lit(None).cast("long")
    for lang, share in shares.items():
        limits = F.when(F.col("lang") == lang, F.lit(int(2**64 * share) - 2**63)).otherwise(limits)
    rows = rows.withColumn("_h", F.xxhash64(F.lit(settings.seed), "doc_id", "lang", "text")).filter(F.coalesce(F.col("_h") < limits, F.lit(True)) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    return rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= settings.rows_per_lang).select("text", "lang", "_nth")


def sample(docs: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[str]]:
    """Texts and labels of :func:`drawn`, by label and hash."""
    pairs = [(r.text, r.lang) for r in drawn(docs, settings).orderBy("lang", "_nth").toLocalIterator()]
    return [t for t, _ in pairs], [x for _, x in pairs]


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """The model of :func:`train` on :func:`sample`, trained in one task; only the model, and no text, comes to the driver."""
    def run(batches):
        texts, langs = [], []
        for pdf in batches:
            texts += pdf["text"].tolist()
            langs += pdf["lang"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(train(texts, langs, settings))]})

    rows = drawn(docs, settings).repartition(1).sortWithinPartitions("lang", "_nth").select("text", "lang")
    got = rows.mapInPandas(run, "model binary").first()
    return pickle.loads(got.model) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text.

    ``und`` with score 0, and rejected, where the text is null or has no letter; also, but not rejected, where no language was learned.
    Rejected are further texts whose score is below the calibrated threshold; ``lang_pred`` is still the best guess.
    Repeated rows get repeated results; lang and other columns are never read.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a fixed size

    def run(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(**_verdicts(pdf["text"].tolist(), handle.value))

    rows = only(docs, "doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def _verdicts(texts: list, model: Model | None) -> dict[str, list]:
    good = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
    pred, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    p, shares = model.scores([texts[i] for i in good]) if model and good else (None, None)
    for k, i in enumerate(good):
        rejected[i] = False
        if p is not None:
            pred[i], score[i] = model.langs[p[k].argmax()], float(min(1.0, p[k].max()))
            rejected[i] = bool(model.rejected(score[i], shares[k]))
    return {"lang_pred": pred, "score": score, "rejected": rejected}


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) with a model learned from the rows that aren't held out."""
    found = predict(docs, fit(docs, settings))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`predict` doesn't reject."""
    handle = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return ~pd.Series(_verdicts(texts.tolist(), handle.value)["rejected"], dtype=bool)

    return docs.filter(accepted(F.col("text")))
