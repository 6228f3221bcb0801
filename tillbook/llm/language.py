"""Language identification: sparse multinomial logistic regression on TF-IDF weights
of character n-grams, trained by follow-the-regularised-leader, then calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.near_duplicates import mixed, randoms
from tillbook.operators.staging import staged

ORDERS = (1, 2, 3)
# n-grams are told apart by hash; so many features, a power of two.
FEATURES = 1 << 16
# Characters of a text that are turned into n-grams at a time.
CHUNK = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """``weights`` per language and feature, ``idf`` per feature, and a temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float


def letters_table() -> np.ndarray:
    """Code point to lower-case code point; 32 for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x33480):  # no letters are assigned beyond
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_counts(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their counts; n-grams run over letters with one space between words."""
    total = np.zeros(FEATURES, np.int64)
    factors = randoms(max(ORDERS) + 1, 9) | np.uint64(1)
    tail = np.full(1, 32, np.uint32)
    for at in range(0, len(text), CHUNK):
        codes = table[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([tail, codes] if at + CHUNK < len(text) else [tail, codes, np.full(1, 32, np.uint32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        fresh = min(len(tail), len(codes))
        for n in ORDERS:
            # Of n-grams that end in the part carried over, all are counted already.
            first = max(0, fresh - n + 1) if at else 0
            if len(codes) - n + 1 > first:
                value = np.full(len(codes) - n + 1 - first, n, np.uint64)
                for i in range(n):
                    value = value + codes[first + i : len(codes) - n + 1 + i].astype(np.uint64) * factors[i]
                if n == 1:
                    value = value[codes[first:] != 32]
                total += np.bincount((mixed(value) >> np.uint64(40)) & np.uint64(FEATURES - 1), minlength=FEATURES)
        tail = codes[-(max(ORDERS) - 1) :]
    features = np.flatnonzero(total)
    return features, total[features]


def tf_idf(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[features]
    return weights / max(float(np.sqrt(weights @ weights)), 1e-12)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the documents of this id are kept from learning; NULL ids are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each feature; all of them, not a sample.

    What reaches the driver has one number per feature.
    """

    def count(batches):
        table, n, total = letters_table(), 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                features, _ = gram_counts(text, table)
                total[features] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"feature": np.arange(-1, FEATURES), "n": np.concatenate([[n], total])})

    counted = docs.select("text").mapInArrow(count, "feature bigint, n bigint")
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n")).toPandas().set_index("feature")["n"]
    return int(counted.get(-1, 0)), counted.reindex(range(FEATURES), fill_value=0).to_numpy()


def training_sample(docs: DataFrame, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``language, features, counts`` of about ``per_language`` documents of each language.

    A language with more is thinned by a hash of id and text; texts count as a whole.
    """
    sizes = staged(docs.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share")), "language-shares")
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 11) / F.lit(float(2**53))
    chosen = docs.join(sizes, "lang").filter(spot < F.col("share")).select("lang", "text", spot.alias("spot"))

    def count(batches):
        table = letters_table()
        for batch in batches:
            found = [gram_counts(text, table) for text in batch["text"].to_pylist()]
            arrays = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["spot"], *arrays], names=["lang", "spot", "features", "counts"])

    rows = chosen.mapInArrow(count, "lang string, spot double, features array<bigint>, counts array<bigint>").toArrow().sort_by([("spot", "ascending"), ("lang", "ascending")])
    return [(lang, np.array(f.values), np.array(c.values)) for lang, f, c in zip(rows["lang"].to_pylist(), rows["features"], rows["counts"])]


def follow_the_leader(
    rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> np.ndarray:
    """Weights after online learning, one document at a time (FTRL-proximal).

    The elastic net enters in closed form: ``l1`` leaves a weight at zero until its
    gradients add up to more, ``l2`` draws the others back.
    """
    z, n = np.zeros((n_languages, FEATURES)), np.zeros((n_languages, FEATURES))

    def weights(features) -> np.ndarray:
        pull = z[:, features]
        rate = (beta + np.sqrt(n[:, features])) / alpha + l2
        return np.where(np.abs(pull) <= l1, 0.0, -(pull - np.sign(pull) * l1) / rate)

    for _ in range(epochs):
        for label, features, values in rows:
            w = weights(features)
            error = softmax(w @ values)
            error[label] -= 1
            gradient = error[:, None] * values
            grown = n[:, features] + gradient * gradient
            z[:, features] += gradient - (np.sqrt(grown) - np.sqrt(n[:, features])) / alpha * w
            n[:, features] = grown
    return weights(slice(None))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def calibrated(rows: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray) -> float:
    """The temperature under which held-back documents are most likely (golden section).

    One document's worth of doubt is spread over the languages, as in Platt's targets,
    so that languages that never mix don't end with certainty.
    """
    scores = [(label, weights[:, features] @ values) for label, features, values in rows]
    if not scores:
        return 1.0
    doubt = 1 / (len(scores) + 2)

    def loss(log_t: float) -> float:
        total = 0.0
        for label, score in scores:
            logs = score / np.exp(log_t)
            logs = logs - logs.max()
            logs = logs - np.log(np.exp(logs).sum())
            total -= (1 - doubt) * logs[label] + doubt * logs.mean()
        return float(total)

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    docs: DataFrame, per_language: int = 1000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3
) -> Model:
    """Learn from the ``text`` and non-NULL ``lang`` of ``docs``.

    Document frequencies come from all texts; weights and temperature from a sample of
    about ``per_language`` documents of each language, of which each fifth calibrates.
    """
    known = docs.filter(F.col("lang").isNotNull() & has_letters(F.col("text"))).select("doc_id", "lang", "text")
    total, with_feature = frequencies(known)
    idf = np.log((1 + total) / (1 + with_feature)) + 1
    found = training_sample(known, per_language)
    languages = sorted({lang for lang, _, _ in found})
    number = {lang: i for i, lang in enumerate(languages)}
    rows = [(number[lang], features, tf_idf(features, counts, idf)) for lang, features, counts in found]
    held_back = rows[::5] if len(rows) >= 10 else []
    learnt = [row for i, row in enumerate(rows) if i % 5 or not held_back]
    weights = follow_the_leader(learnt, len(languages), alpha, beta, l1, l2, epochs)
    return Model(languages, weights, idf, calibrated(held_back, weights))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from the text alone.

    ``und`` and score 0 where the text is NULL or has no letters, or where nothing was
    learnt from. Ties go to the first language by name; an empty table gives none.
    """
    plan = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.idf, model.temperature))

    def guess(batches):
        table = letters_table()
        languages, weights, idf, temperature = plan.value
        for batch in batches:
            names, scores = [], []
            for text, some in zip(batch["text"].to_pylist(), batch["letters"].to_pylist()):
                if not some or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                features, counts = gram_counts(text, table)
                chances = softmax(weights[:, features] @ tf_idf(features, counts, idf) / temperature)
                best = int(chances.argmax())
                names.append(languages[best])
                scores.append(float(chances[best]))
            columns = [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text", has_letters(docs["text"]).alias("letters"))
    return rows.mapInArrow(guess, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, train(docs.filter(~held_out(docs["doc_id"])), **options))
