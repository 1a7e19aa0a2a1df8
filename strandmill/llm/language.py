"""Language ID by nearest centroid over TF-IDF vectors of byte n-grams.

Texts are reduced to letters (bytes of A-Z, lower-cased, a-z and non-ASCII) with single spaces between runs; bigrams and
trigrams of these bytes are hashed into `DIMENSIONS` counts.  Vectors are `log(1 + count) * idf`, normalised.  Each
language has several centroids, from spherical k-means on a bounded sample of its labelled rows; a document gets the
language of the centroid with the largest cosine and is rejected if even that one is too far away.  How far is too far is
measured for each language and length of text: rows of the sample, whole and cut short, against centroids of the other half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.common import extend, shield, table
from strandmill.llm.kernels import slices

DIMENSIONS = 4096
#: Characters that rows of the sample are cut to, and the length classes (by binary logarithm of the n-grams in a text).
CLIPS, CLASSES = (16, 48, 128, 320, 800), 16
_LETTER = re.compile(r"[^\W\d_]")


def _letter_bytes() -> np.ndarray:
    out = np.full(256, 0x20, dtype=np.uint8)
    out[0x61:0x7B] = out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


_FOLD = _letter_bytes()


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed n-gram counts, one row for each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    # each text stands between two spaces of its own
    data = _FOLD[np.frombuffer(b" " + b"  ".join(raw) + b" ", dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), [len(b) + 2 for b in raw])
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (owner[1:] != owner[:-1])
    owner = owner[keep]
    data = data[keep].astype(np.uint32)
    out = np.zeros(len(raw) * DIMENSIONS, dtype=np.int64)
    for width in (2, 3):
        if len(data) < width:
            continue
        size = len(data) - width + 1
        code = np.full(size, width, dtype=np.uint32)
        for k in range(width):
            code = code * np.uint32(0x01000193) ^ data[k : k + size]
        code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - 12)
        same = owner[:size] == owner[width - 1 :]
        out += np.bincount(owner[:size][same] * DIMENSIONS + code[same], minlength=len(out))
    return out.reshape(len(raw), DIMENSIONS)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: The language of each centroid, whether it has enough rows to accept texts, and the least cosine by language and length class.
    of: np.ndarray
    common: np.ndarray
    floor: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(rows.astype(np.float32)) * self.idf)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, its cosine and whether the nearest of the common ones is too far away."""
        cosine = self.vectors(rows) @ self.centroids.T
        best = cosine.argmax(axis=1)
        far = cosine[:, self.common].max(axis=1) < self.least(best, rows.sum(axis=1))
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1), far


    def least(self, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The least cosines accepted for texts of so many n-grams, between the length classes' middles by interpolation."""
        at = np.clip(np.log2(np.maximum(sizes, 1)) - 0.5, 0, CLASSES - 1)
        low = at.astype(int)
        floor = self.floor[self.of[best]]
        each = np.arange(len(low))
        return floor[each, low] * (1 - at + low) + floor[each, np.minimum(low + 1, CLASSES - 1)] * (at - low)


def _learn(rows: np.ndarray, labels: np.ndarray, languages: list[str], clusters: int, rounds: int) -> Model:
    """A model that rejects nothing."""
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(languages, idf, np.empty((0, DIMENSIONS), np.float32), np.empty(0, int), np.empty(0, bool), np.zeros((len(languages), CLASSES)))
    vectors = model.vectors(rows)
    centroids, of, common = [], [], []
    for k in np.unique(labels).tolist():
        own = vectors[labels == k]
        centre = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
        for _ in range(rounds):
            nearest = (own @ centre.T).argmax(axis=1)
            sums = np.zeros_like(centre)
            np.add.at(sums, nearest, own)
            used = np.bincount(nearest, minlength=len(centre)) > 0
            centre = _unit(sums[used])
        # a centroid of a few odd rows, such as mislabelled ones, would let another language in
        members = np.bincount((own @ centre.T).argmax(axis=1), minlength=len(centre))
        common.append(4 * clusters * members >= len(own))
        centroids.append(centre)
        of += [k] * len(centre)
    model.centroids, model.of, model.common = np.concatenate(centroids), np.array(of), np.concatenate(common)
    return model


def _floors(sizes: np.ndarray, cosines: np.ndarray, share: float, least: int = 50) -> np.ndarray:
    """`share` times the lowest twentieth of the cosines in each length class, so that a few odd rows don't set it.

    No floor is above that of longer texts.  Classes of under `least` texts (but never the fullest) take their neighbours'
    values; below the shortest class left, floors end, as a few letters tell too little.
    """
    kinds = np.clip(np.log2(np.maximum(sizes, 1)).astype(int), 0, CLASSES - 1)
    if not len(kinds):
        return np.zeros(CLASSES)
    texts = np.bincount(kinds, minlength=CLASSES)
    known = np.flatnonzero(texts >= min(least, texts.max()))
    low = [share * float(np.quantile(cosines[kinds == k], 0.05)) for k in known]
    low = np.minimum.accumulate(low[::-1])[::-1]
    return np.interp(np.arange(CLASSES), [known[0] - 1, *known], [0.0, *low])


def fit(rows: np.ndarray, langs: list[str], starts: list[str], clusters: int, rounds: int = 10, share: float = 0.6) -> Model:
    """Fits centroids and floors; `starts` has the texts' beginnings.

    A language's floors come from the cosines of its rows, whole and cut to `CLIPS`, to its centroids as learned from the
    other half of the rows.  A language of a single row has none and rejects nothing.
    """
    languages = sorted(set(langs))
    labels = np.array([languages.index(x) for x in langs])
    model = _learn(rows, labels, languages, clusters, rounds)
    sizes: list[list] = [[] for _ in languages]
    cosines: list[list] = [[] for _ in languages]
    turn = np.zeros(len(labels), dtype=int)
    for k in range(len(languages)):
        turn[labels == k] = np.arange((labels == k).sum()) % 2
    for half in (0, 1):
        if not (turn != half).any():
            continue
        other = _learn(rows[turn != half], labels[turn != half], languages, clusters, rounds)
        for k in np.unique(other.of).tolist():
            chosen = np.flatnonzero((labels == k) & (turn == half))
            if not len(chosen):
                continue
            own = other.centroids[(other.of == k) & other.common].T
            for clip in (None, *CLIPS):
                part = rows[chosen] if clip is None else counts([starts[i][:clip] for i in chosen])
                part = part[part.any(axis=1)]
                sizes[k].append(part.sum(axis=1))
                cosines[k].append((other.vectors(part) @ own).max(axis=1))
    for k in range(len(languages)):
        if sizes[k]:
            model.floor[k] = _floors(np.concatenate(sizes[k]), np.concatenate(cosines[k]), share)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slices(texts):
            packed = [row.astype(np.int32).tobytes() for row in counts(texts[part])]
            starts = [text[: CLIPS[-1]] for text in texts[part]]
            yield pd.DataFrame({"lang": batch["lang"].iloc[part], "rank": batch["rank"].iloc[part], "row": packed, "start": starts})


def train(docs: DataFrame, per_language: int = 400, clusters: int = 4, max_languages: int = 64) -> Model | None:
    """Fits on at most `per_language` rows of each of the `max_languages` most frequent languages; None without any labels.

    The rows are those with the smallest hash of doc_id and text.  Rows that repeat both count once; null texts and rows without
    doc_id or language are left out, as are those whose crc32(doc_id as text) mod 5 is 0.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    sizes = {r["lang"]: r["count"] for r in common.collect()}
    if not sizes:
        return None
    rank = F.xxhash64(F.lit(17), "doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.5 * per_language / n) * (1 << 62))])
    chosen = usable.select("lang", "text", rank.alias("rank")).where(F.col("rank") <= F.try_element_at(limit, F.col("lang")))
    chosen = chosen.groupBy("lang", "rank").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    rows = chosen.mapInPandas(_features, "lang string, rank long, row binary, start string").toPandas()
    rows = rows.sort_values(["lang", "rank"])
    vectors = np.frombuffer(b"".join(rows["row"]), dtype=np.int32).reshape(-1, DIMENSIONS)
    return fit(vectors, rows["lang"].tolist(), rows["start"].tolist(), clusters)


def _predict(shared):
    def run(column: pa.Array) -> tuple[list, list, list]:
        model, texts = shared.value, column.to_pylist()
        written = [has_letter(t) for t in texts]
        if model is None or not any(written):
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        best, cosine, far = model.nearest(counts(texts))
        langs = [model.languages[model.of[k]] if known else "und" for known, k in zip(written, best, strict=True)]
        return langs, np.where(written, cosine, 0.0).astype(float), ~np.array(written) | far

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds `lang_pred`, `score` (the cosine, 0 to 1) and `rejected` to every row of `docs`.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is every row without a model (nothing to
    learn from).  Ties go to the first language in sorted order.  Each row is judged by its own whole text.  Extra columns of
    any name pass through; columns named like the added ones are replaced.  An empty table gives an empty result.
    """
    added = ["lang_pred", "score", "rejected"]
    docs, back = shield(docs, ["text"], added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = extend(docs, _predict(shared), ["text"], "lang_pred string, score double, rejected boolean")
    return out.select(*back, *added)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
