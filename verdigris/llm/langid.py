"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: all byte n-grams of its words (a blank marks their edges),
hashed into a table. A linear softmax reads the language off that mean. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature fitted on rows that training didn't see makes
the scores probabilities. Rejection is calibrated on what the model must not take for its own: vocabularies of subwords
that leave languages out are held against these languages, and texts with shuffled letters, beside known ones; a
logistic regression on the share of subwords that training saw tells them apart, and its threshold is a low quantile
of what unseen rows of the learned languages reach. Once trained, embedding and softmax are one table (a subword's contribution to each
language), so prediction is one lookup for each n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.common import hash_share, small_batches, whole_text

#: Labelled rows of each language that the model is fitted on, at most.
ROWS_PER_LANGUAGE = 800
#: Languages that are learned, at most.
LANGUAGES = 1000
BUCKETS = 1 << 17
DIMENSIONS = 16
SIZES = (2, 3, 4)
EPOCHS = 4
#: Subwords that stand for a training text.
GRAMS = 800
RATE = 0.5
#: Share of unseen labelled examples that may be rejected, and the probability from which nothing is rejected.
REJECTED_SHARE = 0.002
MOST_TO_REJECT = 0.2
#: Training examples that a familiar subword occurs in, at least.
FAMILIAR_FROM = 3
#: Folds of languages that are left out in turn for calibration.
FOLDS = 4
#: Signs of a known language, see ``_signs``.
SIGNS = 4
UNKNOWN = "und"
_CHUNK = 1 << 19

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: what a subword adds
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray  # buckets: whether training saw the subword often enough
    known: np.ndarray  # weights of the signs of a known language
    least: float  # a text less likely than this to be in a known language is rejected
    false_accepts: float = 0.0  # share of the calibration's foreign and garbled examples that are not rejected


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a blank before each text and after the last, and where the texts begin."""
    lengths = np.diff(offsets)
    places = np.arange(offsets[-1] - offsets[0]) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(places) + len(lengths) + max(SIZES), 0x20, np.uint8)
    out[places] = _FOLD[data[offsets[0] : offsets[-1]]]
    return out, offsets[:-1] - offsets[0] + np.arange(len(lengths))


def _buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram at each place; 0 where it would cross from one word into another."""
    count = len(data) - max(SIZES)
    blank = data == 0x20
    hashed = np.full(count, size * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    crosses = blank[:count] & blank[1 : count + 1]
    for k in range(size):
        hashed += data[k : k + count] * _FACTORS[k]
        hashed ^= hashed >> np.uint32(15)
        if 0 < k < size - 1:
            crosses |= blank[k : k + count]
    hashed *= np.uint32(0x2C1B3C6D)
    hashed ^= hashed >> np.uint32(12)
    hashed %= np.uint32(BUCKETS - 1)
    hashed += np.uint32(1)
    hashed[crosses] = 0
    return hashed


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of texts as bytes and offsets."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        yield data, offsets[first : last + 1]
        first = last


def _read(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The mean contribution of each text's subwords, with the bias, and the signs of a known language."""
    found, shares, sizes = [], [], []
    for data, offsets in _texts(column):
        spaced, begins = _spaced(data, offsets)
        sums = np.zeros((len(begins), len(model.languages)), np.float64)
        counts, known = np.zeros(len(begins)), np.zeros(len(begins))
        if len(begins) and len(spaced) > max(SIZES):
            for size in SIZES:
                buckets = _buckets(spaced, size)
                counts += np.add.reduceat(buckets != 0, begins, dtype=np.int64)
                sums += np.add.reduceat(model.table[buckets], begins, axis=0)
                known += np.add.reduceat(model.familiar[buckets], begins)
        found.append(sums / np.maximum(counts, 1)[:, None])
        shares.append(known / np.maximum(counts, 1))
        sizes.append(counts)
    if not found:
        return np.zeros((0, len(model.languages))), np.zeros((0, SIGNS))
    logits = np.concatenate(found) + model.bias
    return logits, _signs(np.concatenate(shares), np.concatenate(sizes))


def _logits(model: Model, column: pa.Array) -> np.ndarray:
    return _read(model, column)[0]


def _is_known(model: Model, signs: np.ndarray) -> np.ndarray:
    return _known(signs, model.known) >= model.least


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


def _examples(texts: list[str]) -> list[list[np.ndarray]]:
    """The subwords of each text as examples: of the whole, and of short stretches, which real short texts are like."""
    found = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        spaced, _ = _spaced(data, np.array([0, len(data)]))
        grams = [_buckets(spaced, size) for size in SIZES]
        whole = np.concatenate([g[g != 0] for g in grams])
        own = [whole[:: 1 + len(whole) // GRAMS]]  # spread over the whole text
        for width in (40, 150):
            at = (len(data) - width) // 2
            if at > 0:
                own.append(np.concatenate([g[at : at + width][g[at : at + width] != 0] for g in grams]))
        found.append([x for x in own if len(x)])
    return found


def _descend(fit: list[tuple[np.ndarray, int]], classes: int, epochs: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """What each subword adds to each class, and the bias, by stochastic gradient descent."""
    weights = len(fit) / (classes * np.maximum(np.bincount([y for _, y in fit], minlength=classes), 1))
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embedding[0] = 0
    output = random.normal(0, 0.1, (DIMENSIONS, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    steps, step = epochs * len(fit), 0
    distinct = [(*np.unique(grams, return_counts=True), own) for grams, own in fit]
    for _ in range(epochs):
        for i in random.permutation(len(distinct)):
            grams, times, own = distinct[i]
            size = times.sum()
            rate = RATE * (1 - step / steps) * min(weights[own], 4.0)
            step += 1
            mean = (times.astype(np.float32) @ embedding[grams]) / size
            error = _softmax(mean @ output + bias)
            error[own] -= 1
            back = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embedding[grams] -= np.outer(times * (rate / np.sqrt(size)), back).astype(np.float32)
    table = (embedding @ output).astype(np.float32)
    table[0] = 0
    return table, bias.astype(np.float64)


def _familiar(fit: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """1 for the subwords that several training examples have."""
    seen = np.zeros(BUCKETS, np.int64)
    for grams, _ in fit:
        seen[np.unique(grams)] += 1
    seen[0] = 0
    return (seen >= FAMILIAR_FROM).astype(np.float32)


def _signs(familiar: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What tells a text of known languages from others: how many of its subwords are familiar, and how sure that is.

    The best score isn't among them: a text in two known languages has a low one, one in an unknown language often a
    high one.
    """
    short = 1 / np.sqrt(np.maximum(counts, 1))
    return np.stack([np.ones(len(counts)), familiar, short, familiar * short], axis=1)


def _example_signs(examples: list[np.ndarray], familiar: np.ndarray) -> np.ndarray:
    return _signs(np.array([familiar[x].mean() for x in examples]), np.array([len(x) for x in examples]))


def _logistic(signs: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression in which both classes count alike, by Newton steps."""
    share = np.where(truth, 0.5 / max(truth.sum(), 1), 0.5 / max((~truth).sum(), 1))
    weights = np.zeros(signs.shape[1])
    for _ in range(25):
        found = 1 / (1 + np.exp(-np.clip(signs @ weights, -30, 30)))
        slope = signs.T @ (share * (found - truth)) + 1e-4 * weights
        bend = (signs * (share * found * (1 - found))[:, None]).T @ signs + 1e-4 * np.eye(len(weights))
        weights -= np.linalg.solve(bend, slope)
    return weights


def _known(signs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probability that a text is in one of the learned languages."""
    return 1 / (1 + np.exp(-np.clip(signs @ weights, -30, 30)))


def _shuffled(text: str, random: np.random.Generator) -> str:
    """The text with its letters in another order, word lengths kept."""
    words = text.split()
    letters = "".join(words)
    order = random.permutation(len(letters))
    mixed, at, out = "".join(letters[i] for i in order), 0, []
    for word in words:
        out.append(mixed[at : at + len(word)])
        at += len(word)
    return " ".join(out)


def _rejection(texts: list[str], examples: list[list[np.ndarray]], truth: np.ndarray, fit: np.ndarray, probe: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights that tell known languages from others, and what they say of the examples of unknown ones.

    The languages are dealt into folds. For each fold the vocabulary of subwords is that of the other languages only;
    probes of the fold are texts of an unknown language to it, probes of the others are known, and probes with shuffled
    letters are unknown.
    """
    languages = int(truth.max()) + 1
    signs, known = [], []
    garbled = [x for i in probe for x in _examples([_shuffled(texts[i], random)])[0]]
    for fold in range(min(languages, FOLDS)):
        outside = truth % FOLDS == fold
        learn = [(x, 0) for i in fit if not outside[i] for x in examples[i]]
        if not learn:
            continue
        familiar = _familiar(learn)
        for rows, is_known in (
            ([x for i in probe if not outside[i] for x in examples[i]], True),
            ([x for i in probe if outside[i] for x in examples[i]], False),
            (garbled, False),
        ):
            if rows:
                signs.append(_example_signs(rows, familiar))
                known.append(np.full(len(rows), is_known))
    if not signs:
        return np.zeros(SIGNS), np.zeros(0)
    every, truth = np.concatenate(signs), np.concatenate(known)
    weights = _logistic(every, truth)
    return weights, _known(every[~truth], weights)


def train(texts: list[str], languages: list[str], seed: int = 5) -> Model | None:
    """Fit a model; None without labelled text. A tenth of the rows is kept out for temperature and rejection."""
    names = sorted(set(languages))
    examples = _examples(texts)
    truth = np.array([names.index(x) for x in languages], int)
    kept = [i for i in range(len(texts)) if examples[i]]
    if not kept:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(kept)
    probe, rest = order[: len(order) // 10], order[len(order) // 10 :]
    fit = [(x, truth[i]) for i in rest for x in examples[i]]
    table, bias = _descend(fit, len(names), EPOCHS, random)
    model = Model(names, table, bias, 1.0, _familiar(fit), np.zeros(SIGNS), 0.0)
    if len(probe):
        logits = np.array([table[examples[i][0]].mean(axis=0) for i in probe]) + bias
        own = truth[probe]
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(own)), own] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.known, foreign = _rejection(texts, examples, truth, rest, probe, random)
        scores = _known(_example_signs([x for i in probe for x in examples[i]], model.familiar), model.known)
        model.least = float(min(np.quantile(scores, REJECTED_SHARE), MOST_TO_REJECT))
        model.false_accepts = float((foreign >= model.least).mean()) if len(foreign) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id, as text, modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """Train on labelled rows that aren't held out: of each language, those whose ids have the smallest hashes.

    The model holds a column for each language, so at most ``languages`` of them are learned, those with the most
    rows. Their counts make a filter that only a bounded share of the rows passes before any row is moved.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    with_letters = labelled.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    counts = (
        with_letters.groupBy("lang").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "lang").limit(languages)
    ).collect()
    if not counts:
        return None
    count = F.create_map(*(F.lit(value) for row in counts for value in (row.lang, row["count"])))[F.col("lang")]
    place = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id")
    chosen = (
        with_letters.where(hash_share("doc_id", count, rows_per_language))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= rows_per_language)
        .select("doc_id", "lang")
        .distinct()
    )
    # At most rows_per_language ids of each language, so the broadcast is bounded.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    once = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sorted((row.doc_id, row.lang, row.text) for row in once.collect())
    return train([text for _, _, text in got], [lang for _, lang, _ in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row, from the text alone.

    Null text and text without a letter are ``und`` with score 0 and rejected; so is all where nothing could be
    learned. Rows that repeat get the same prediction. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), bool)
            if own is None:
                names, scores = [UNKNOWN] * len(letters), np.zeros(len(letters))
                rejected = np.ones(len(letters), bool)
            else:
                logits, signs = _read(own, batch.column(1))
                odds = _softmax(logits / own.temperature)
                best = odds.argmax(axis=1)
                scores = np.where(letters, odds[np.arange(len(best)), best], 0.0)
                names = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                rejected = ~letters | ~_is_known(own, signs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    small = small_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), letter.alias("letter")))
    found = small.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language prediction is rejected; all columns as they were.

    Where no model could be fitted (no labelled row with an id and letters that isn't held out), nothing is known against
    any text: those with a letter stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series, letters: pd.Series) -> pd.Series:
        own = model.value
        if own is None:
            return letters.astype(bool)
        _, signs = _read(own, pa.array(texts.fillna(""), pa.string()))
        return pd.Series(letters.to_numpy(bool) & _is_known(own, signs))

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return small_batches(docs).where(known(whole_text(), letter))
