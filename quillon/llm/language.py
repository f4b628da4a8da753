"""Language identification with string kernels.

A text is its sets of byte n-grams, n from 1 to 3, over the whole text with A-Z lowered. The blended-spectrum presence kernel of two texts is the sum over n of the common n-grams divided by the root
of the product of both counts. A few training texts of each language are Nyström landmarks: texts are mapped by their
kernel values against the landmarks and the inverse root of the landmarks' own kernel matrix. One-versus-rest kernel
ridge regression on that map gives a score a language; batches are scored by matrix products.

Learned from a bounded sample: PER_LANGUAGE texts of each language, of which LANDMARKS are landmarks, of LANGUAGES
languages at most (those with the most rows) and BYTES bytes for each. Null texts and texts without a letter are `und`
with score 0. Without any training row every text is. Every row is scored alone, so repeated rows get the same result;
of languages with the same score the first in alphabetical order is taken; long texts count whole; rows without doc_id
are scored but not learned from; an empty table gives an empty one. Columns that aren't asked for are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import held_out, short, utf8

PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 400, 24, 1e-2, 6.0
#: Languages that are learned, and bytes of the texts of one.
LANGUAGES, BYTES = 256, 4 << 20
NGRAMS = (1, 2, 3)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def presence(data: np.ndarray) -> list[np.ndarray]:
    """Which n-grams a text has: their sorted codes for each n."""
    x = _LOWER[data]
    out = []
    for n in NGRAMS:
        code = x[: max(0, len(x) - n + 1)].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | x[k : len(x) - n + 1 + k]
        code.sort()
        out.append(code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code)
    return out


@dataclass
class Model:
    languages: list[str]
    columns: list[np.ndarray]  # for each n, the codes that some landmark has
    landmarks: np.ndarray  # normalised presence of these codes, a row for each landmark
    weights: np.ndarray  # kernel values against the landmarks to a score for each language

    def rows(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised presence of the landmarks' codes in each text."""
        out = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        for row, text in zip(out, texts, strict=True):
            at = 0
            for codes, columns in zip(presence(text), self.columns, strict=True):
                if len(codes) and len(columns):
                    place = np.minimum(np.searchsorted(columns, codes), len(columns) - 1)
                    row[at + place[columns[place] == codes]] = 1 / np.sqrt(len(codes))
                at += len(columns)
        return out

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and the softmax of its score."""
        scores = (self.rows(texts) @ self.landmarks.T) @ self.weights
        e = np.exp(SHARPNESS * (scores - scores.max(axis=1, keepdims=True)))
        best = scores.argmax(axis=1)
        return [self.languages[i] for i in best], (1 / e.sum(axis=1)).astype(float)


def fit(texts: list[bytes], langs: list[str], *, landmarks: int = LANDMARKS) -> Model | None:
    """The first `landmarks` texts of each language are landmarks; all texts train the regression."""
    languages = sorted(set(langs))
    if not languages:
        return None
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    chosen = [i for lang in languages for i in [i for i, x in enumerate(langs) if x == lang][:landmarks]]
    columns = [np.unique(np.concatenate(codes)) for codes in zip(*(presence(arrays[i]) for i in chosen), strict=True)]
    model = Model(languages, columns, np.zeros((0, sum(map(len, columns))), np.float32), np.zeros((0, 0)))
    model.landmarks = model.rows([arrays[i] for i in chosen])
    own = (model.landmarks @ model.landmarks.T).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    features = (model.rows(arrays) @ model.landmarks.T).astype(float) @ root
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # equal weight for each language, however many texts it has
    weight = 1 / np.bincount(np.searchsorted(languages, langs))[np.searchsorted(languages, langs)]
    gram = (features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(gram, (features * weight[:, None]).T @ target)).astype(np.float32)
    return model


def learn(docs: DataFrame, *, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Learns from at most per_language texts of each language, those whose doc_id has the smallest hash."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").rlike("\\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    # half as many again as are needed pass the hash's threshold; the smallest hashes of these are taken
    # (a table of literals: createDataFrame of rows starts Python workers of a second kind, which stay for a minute)
    share = [F.struct(F.lit(r["lang"]).alias("lang"), F.lit(min(1.0, (1.5 * per_language + 30) / r["n"])).alias("share")) for r in counts]
    shares = spark.range(0, 1, 1, 1).select(F.inline(F.array(*share)))
    unit = (F.xxhash64("doc_id").cast("double") / float(1 << 64)) + 0.5
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    some = known.join(F.broadcast(shares), "lang").where(unit <= F.col("share")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    # the sample's texts up to the bound of bytes, but one of each language at least
    held = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n"))
    rows = some.withColumn("held", held).where((F.col("held") <= BYTES) | (F.col("n") == 1)).orderBy("lang", "n").select("lang", "text").collect()
    return fit([r["text"].encode() for r in rows], [r["lang"] for r in rows], landmarks=landmarks)


def _predict(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = utf8(column)
    langs, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    lettered = [i for i, t in enumerate(column.to_pylist()) if t and _LETTER.search(t)]
    for at in range(0, len(lettered) if model else 0, 128):
        part = lettered[at : at + 128]
        found, s = model.predict([data[offsets[i] : offsets[i + 1]] for i in part])
        for i, lang in zip(part, found, strict=True):
            langs[i] = lang
        scores[part] = s
    return langs, scores


def identify(docs: DataFrame, model: Model | None, *extra: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, and the extra columns of docs that are named.

    The text goes to the workers once, also where it is an extra column.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").alias("_text"), *[F.col(c) for c in extra if c not in ("doc_id", "text")]]
    given = docs.select(*columns)
    place = {f.name: i for i, f in enumerate(given.schema.fields)} | {"text": 2}
    out = [c for c in extra if c != "doc_id"]

    def run(batches):
        for b in short(batches):
            langs, scores = _predict(shared.value, b.column(2))
            arrays = [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores), *[b.column(place[c]) for c in out]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", *out])

    more = "".join(f", `{c}` {given.schema[place[c]].dataType.simpleString()}" for c in out)
    return given.mapInArrow(run, f"doc_id bigint, held_out boolean, lang_pred string, score double{more}")


def keep_known(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Documents whose language is found with a score of at least `least`, with the columns they came with.

    doc_id must be a whole number; the text's columns travel through the scoring and are not shuffled.
    """
    # the other columns travel as one struct, so that none can clash with what is found
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    known = identify(whole, learn(docs), "text", "_row").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
