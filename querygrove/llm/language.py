"""Language identification by string kernels.

A text is the sets of its distinct 1-, 2- and 3-grams of letters, of any script (a blended
spectrum). The kernel of
two texts is, summed over the lengths, the number of grams that both have over the root of the
product of their numbers. A bounded sample of texts serves as Nystroem landmarks; one-versus-rest
kernel ridge regression is fitted on a larger one. Texts are scored in batches: a matrix of gram
presence times the landmarks' matrix gives the kernel values, and these times the coefficients
the score of each language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from . import textkernels as K
from .shared import crc_mod, read, small_batches

LENGTHS = (1, 2, 3)
#: Fitting reads about this many documents of each language, and as many landmarks.
SAMPLE_DOCS, LANDMARKS = 600, 48
#: More languages than this are refused: their counts are taken to the driver.
MOST_CLASSES = 2_000
#: Sampled documents and landmarks of all languages together, and characters of a sampled document
#: and of a landmark. A language has at least one of each where it has one that short.
MOST_DOCS, MOST_LANDMARKS, MOST_CHARS, LANDMARK_CHARS = 4_000, 256, 200_000, 20_000
BATCH = 256
#: A landmark matrix of up to this many values is kept dense, larger ones by column.
DENSE = 1 << 23
U64 = K.U64
_GRAM_BITS = U64(40)
_is_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _is_letter:
        _is_letter.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _is_letter[0]


def presence(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length the (row, gram) pairs of the texts, each once; and which texts have a letter.

    A symbol is a lower-cased letter of any script, each its own; all else is one symbol. A gram is
    a 40-bit hash of its length and symbols."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = np.where(letters()[points], points, 0).astype(U64)
    row = np.repeat(np.arange(len(low), dtype=np.int64), size)
    has = np.bincount(row[symbol > 0], minlength=len(low)) > 0
    out, gram = [], np.zeros(len(symbol), U64)
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            last = symbol[n - 1 :]
            gram = gram[: len(last)] * U64(0x9E3779B97F4A7C15) + K.mix(last + U64(0xD1342543DE82EF95))
            inside = row[: len(last)] == row[n - 1 :][: len(last)]
            short = K.mix(gram[inside] + U64(n)) >> (U64(64) - _GRAM_BITS)
            keys = np.unique((row[: len(last)][inside].astype(U64) << _GRAM_BITS) | short)
            out.append(((keys >> _GRAM_BITS).astype(np.int64), keys & ((U64(1) << _GRAM_BITS) - U64(1))))
    return out, has


@dataclass
class Model:
    """grams: those of the landmarks, sorted; begin, owner, weight: the landmarks that have each and
    the entry's value; alpha: landmarks x languages."""

    langs: list[str]
    grams: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    weight: np.ndarray
    landmarks: int
    alpha: np.ndarray
    sharpness: float = 8.0
    whole: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"whole": None}

    def columns(self, used: np.ndarray) -> np.ndarray:
        """The landmark matrix's rows for some grams: grams x landmarks."""
        if self.whole is None and len(self.grams) * self.landmarks <= DENSE:
            self.whole = self._dense(np.arange(len(self.grams)))
        return self.whole[used] if self.whole is not None else self._dense(used)

    def _dense(self, used: np.ndarray) -> np.ndarray:
        out = np.zeros((len(used), self.landmarks), np.float32)
        size = self.begin[used + 1] - self.begin[used]
        at = np.repeat(self.begin[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[np.repeat(np.arange(len(used)), size), self.owner[at]] = self.weight[at]
        return out

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts and landmarks, as a product of two presence matrices; and which
        texts have a letter."""
        pairs, has = presence(texts)
        rows, cols, values = [], [], []
        for row, gram in pairs:
            scale = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1))).astype(np.float32)
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            known = self.grams[at] == gram
            rows.append(row[known])
            cols.append(at[known])
            values.append(scale[row[known]])
        used, at = np.unique(np.concatenate(cols), return_inverse=True)
        x = np.zeros((len(texts), len(used)), np.float32)
        x[np.concatenate(rows), at] = np.concatenate(values)
        return x @ self.columns(used), has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and a score between 0 and 1 of each text; `und` and 0 where there is no letter.
        Ties go to the language that comes first by name."""
        k, has = self.kernel(texts)
        s = (k @ self.alpha) * self.sharpness
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = s.argmax(axis=1)
        score = np.where(has, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.clip(score, 0.0, 1.0)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model | None:
    """A model of labelled texts; None without any. The rows' order is the order of choice; shorter
    texts than LANDMARK_CHARS are landmarks before longer ones."""
    if not texts:
        return None
    names = sorted(set(langs))
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    chosen: list[int] = []
    for lang in names:
        own = [i for i, x in enumerate(langs) if x == lang]
        chosen += sorted(own, key=lambda i: len(texts[i]) > LANDMARK_CHARS)[:landmarks]
    gram, owner, weight = [], [], []
    for row, g in presence([texts[i] for i in chosen])[0]:
        n = np.bincount(row, minlength=len(chosen))
        gram.append(g)
        owner.append(row)
        weight.append((1 / np.sqrt(np.maximum(n, 1)))[row])
    gram, owner, weight = np.concatenate(gram), np.concatenate(owner), np.concatenate(weight).astype(np.float32)
    order = np.lexsort((owner, gram))
    grams, first = np.unique(gram[order], return_index=True)
    if not len(grams):
        grams, first = np.zeros(1, U64), np.zeros(1, np.int64)
    model = Model(names, grams, np.append(first, len(gram)), owner[order].astype(np.int32), weight[order], len(chosen), np.zeros((0, 0), np.float32))
    k = np.concatenate([model.kernel(texts[i : i + BATCH])[0] for i in range(0, len(texts), BATCH)]).astype(np.float64)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    model.alpha = np.linalg.solve(k.T @ k + ridge * len(texts) * k[chosen] + 1e-6 * np.eye(len(chosen)), k.T @ y).astype(np.float32)
    return model


def sample(docs: DataFrame, column: str, per_class: int) -> list[tuple]:
    """About per_class rows (class, doc_id, text) of each class, picked by a hash of the id: the
    counts of the classes come from a scan of two columns, the texts from one scan that sends on
    only what is picked. Sorted by that hash. More than MOST_CLASSES classes are refused."""
    counts = {r[0]: r[1] for r in docs.groupBy(column).count().take(MOST_CLASSES + 1)}
    if not counts:
        return []
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} languages")
    per_class = min(per_class, max(1, MOST_DOCS // len(counts)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    most = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, int((1 << 30) * min(1.0, per_class / n)))))
    rows = docs.where(place < most[F.col(column)]).where(F.length("text") <= MOST_CHARS).select(column, "doc_id", F.col("text").cast("string").alias("text"), place.alias("place")).collect()
    return [(r[0], r[1], r[2]) for r in sorted(rows, key=lambda r: (r["place"], str(r[0]), r[2]))]


def train(docs: DataFrame, per_class: int = SAMPLE_DOCS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on docs(doc_id, text, lang): rows with a null text or lang, or a null id, teach nothing,
    nor do texts of more than MOST_CHARS characters. Repeated rows count as often as they stand. An
    empty table gives no model."""
    rows = sample(docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL"), "lang", per_class)
    return fit([r[2] for r in rows], [r[0] for r in rows], landmarks)


def identify(docs: DataFrame, model: Model | None, into: str = "language") -> DataFrame:
    """docs(text, ...) with a struct column `into` of lang_pred and score.

    A null or empty text, one without a letter, and every text if there is no model, is `und` with
    score 0. Very long texts are read whole. Repeated rows are judged alike; ties go to the language
    that comes first by name. An empty table stays empty. Other columns stay, and one that is called
    like `into` gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            langs, scores = [], []
            held: list[str] = []

            def flush() -> None:
                if held:
                    a, b = m.predict(held) if m else (["und"] * len(held), np.zeros(len(held)))
                    langs.extend(a)
                    scores.extend(b.tolist())
                    held.clear()

            size = 0
            for at in range(0, len(texts), BATCH):
                for t in texts.slice(at, BATCH).to_pylist():
                    held.append(t or "")
                    size += len(held[-1])
                    if len(held) == BATCH or size > 1 << 20:
                        flush()
                        size = 0
            flush()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(into, run(F.col("text").cast("string")))


def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out; rows with a null id are
    not held out and teach nothing."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "language.*")
