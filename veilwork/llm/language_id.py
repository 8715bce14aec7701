"""Language identification with hyperdimensional profiles.

Each letter (code point) has a random vector of signs. The vectors of an n-gram's letters are permuted by their place
(rotated) and bound (multiplied); the n-gram vectors of a text are bundled (added). A language's prototype
is the bundle of its training texts, and a text gets the language of the prototype with the largest cosine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.shared import broadcast_parameter, free_name, once_per_worker, staged, tidy

#: Components of a vector.
DIMENSION = 2048
#: Letters of an n-gram.
GRAM = 3
#: Texts that are bundled together, and n-grams whose vectors are built at once: what a task holds at a time.
TEXTS, GRAMS = 256, 1024
#: Bits of a code point; the code points of an n-gram fit in one long.
BITS = 21


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a lower-cased text and how often each occurs; none where it has no letter.

    A run of characters that are no letters is one gap, as are both ends; n-grams that are nothing
    but gap at their middle are left out.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    code = np.concatenate([[0], np.where(is_letter[code], code, 0), [0]])
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    n = len(code) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(n, np.int64)
    for place in range(GRAM):
        gram = gram << BITS | code[place : place + n]
    return np.unique(gram[code[1 : 1 + n] > 0], return_counts=True)


def letter_vectors(codes: np.ndarray, dimension: int, seed: int = 7) -> np.ndarray:
    """The signs of each code point, that of the gap (0) included: derived from it alone, so all tasks agree on them."""
    bits = [np.frombuffer(np.random.default_rng([seed, int(c)]).bytes(-(-dimension // 8)), np.uint8) for c in codes]
    return (np.unpackbits(np.array(bits), axis=1, count=dimension).astype(np.int8) * 2 - 1).reshape(-1, dimension)


def gram_vectors(at: np.ndarray, dimension: int) -> np.ndarray:
    """The vectors of n-grams: the signs of their letters, rotated by how far each is from the end, multiplied."""
    places = [at >> BITS * (GRAM - 1 - place) & (1 << BITS) - 1 for place in range(GRAM)]
    codes = np.unique(np.concatenate(places))
    signs = letter_vectors(codes, dimension)
    bound = np.ones((len(at), dimension), np.int8)
    for place, code in enumerate(places):
        bound *= np.roll(signs, GRAM - 1 - place, axis=1)[np.searchsorted(codes, code)]
    return bound


def bundle(counted: list[tuple[np.ndarray, np.ndarray]], dimension: int) -> np.ndarray:
    """The sum of each text's n-gram vectors, for texts given by their n-grams and counts.

    An n-gram that several of the texts have gets its vector once; GRAMS of them are built at a time.
    """
    out = np.zeros((len(counted), dimension), np.float32)
    at = np.concatenate([c[0] for c in counted])
    if not len(at):
        return out
    row, count = np.repeat(np.arange(len(counted)), [len(c[0]) for c in counted]), np.concatenate([c[1] for c in counted])
    distinct, place = np.unique(at, return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, count, place = row[order], count[order], place[order]
    for low in range(0, len(distinct), GRAMS):
        part = distinct[low : low + GRAMS]
        a, b = np.searchsorted(place, [low, low + len(part)])
        weight = np.zeros((len(counted), len(part)), np.float32)
        weight[row[a:b], place[a:b] - low] = count[a:b]
        out += weight @ gram_vectors(part, dimension).astype(np.float32)
    return out


def unit(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams with their counts scaled to unit length."""
    return at, count / max(float(np.linalg.norm(count)), 1.0)


def learn_prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang", dimension: int = DIMENSION) -> DataFrame:
    """The prototype of each language: (lang, bundle of its texts), one row for each label.

    Each text's counts have unit length, so a long text says no more than a short one. All rows teach, repeated ones each time, but for those with a null label, null text or no letters. Each task
    bundles its texts first; what is shuffled is one vector for each task and label. An empty table gives no prototype.
    """
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    @tidy
    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, sums = once_per_worker("letters", _letters), {}
        for b in batches:
            for low in range(0, b.num_rows, TEXTS):
                by_lang: dict[str, list] = {}
                for name, t in zip(b.column("lang").slice(low, TEXTS), b.column("text").slice(low, TEXTS), strict=True):
                    by_lang.setdefault(name.as_py(), []).append(unit(*grams(t.as_py(), is_letter)))
                counted = []
                for parts in by_lang.values():
                    at, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    counted.append((at, np.bincount(place, np.concatenate([p[1] for p in parts]), len(at))))
                for name, (at, _), v in zip(by_lang, counted, bundle(counted, dimension), strict=True):
                    if len(at):
                        sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimension), pa.array(range(dimension), pa.int32()), pa.array(v)], ["lang", "place", "value"])

    parts = rows.mapInArrow(bundles, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    return parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("prototype"))


def _guess(shared: Broadcast, dimension: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    key = uuid.uuid4().hex

    def load() -> tuple[list[str], np.ndarray]:
        names, vectors = shared.value
        matrix = np.array(vectors, np.float64).reshape(len(names), dimension)
        return names, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).T

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        is_letter = once_per_worker("letters", _letters)
        names, prototypes = once_per_worker(("prototypes", key), load)
        for batch in batches:
            best, score = ["und"] * len(batch), np.zeros(len(batch))
            for low in range(0, len(batch), TEXTS):
                counted = [grams(v.as_py(), is_letter) for v in batch.slice(low, TEXTS)]
                if not names:
                    continue
                vectors = bundle(counted, dimension)
                cosine = vectors @ prototypes / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for i, j in enumerate(cosine.argmax(1)):
                    if len(counted[i][0]):
                        best[low + i], score[low + i] = names[j], min(1.0, max(0.0, float(cosine[i, j])))
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], ["lang", "score"])

    return tidy(guess)


def prototype_parameter(spark: SparkSession, prototypes: DataFrame, dimension: int = DIMENSION) -> Broadcast:
    """Prototypes, few and of fixed size, brought to the driver behind a check of their number and broadcast."""
    prototypes = staged(prototypes, "prototypes")  # learned once, then counted and read
    n = prototypes.count()
    if n * dimension * 8 > 64 << 20:
        raise ValueError(f"{n} labels are too many for one broadcast")
    rows = sorted((r.lang, list(r.prototype)) for r in prototypes.collect())
    return broadcast_parameter(spark, ([r[0] for r in rows], [r[1] for r in rows]), n * dimension * 8)


def predict(df: DataFrame, prototypes: DataFrame, text: str = "text", lang: str = "lang_pred", score: str = "score", dimension: int = DIMENSION) -> DataFrame:
    """Add the language whose prototype has the largest cosine with the text's vector, and that cosine, 0 at least.

    A null text, one without letters, and any text where nothing was learned get `und` and 0. Of prototypes
    that tie, the first by name wins. Rows and other columns stay; columns of the two names are replaced; an
    empty table stays empty. The whole text is read, and nothing else of the row; no shuffle.
    """
    shared = prototype_parameter(df.sparkSession, prototypes, dimension)
    guess = F.arrow_udf(_guess(shared, dimension), "struct<lang:string,score:double>")(F.col(f"`{text}`"))
    own = free_name(df, "guess")
    found = df.withColumn(own, guess)
    return found.withColumns({lang: F.col(f"{own}.lang"), score: F.col(f"{own}.score")}).drop(own)


def fold(doc_id: Column, folds: int = 4) -> Column:
    """A document's fold: CRC-32 of its id as text, modulo folds; null ids are in that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
