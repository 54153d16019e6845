"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +-1, drawn from its code point.  A letter trigram is the product
of its letters' vectors, permuted (rotated) by their places; a text is the sum of its trigrams'
vectors, and a language's prototype the sum of its training texts' unit vectors.  The language is
that of the prototype with the largest cosine.

Prototypes are fitted on about ``FIT_TEXTS`` texts of each language at most, chosen by a hash of the
id and the text; rows that repeat both teach once.  Every text is classified as a whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import small_batches, table, with_text
from quern.llm.quality import fold

DIMENSION = 1024
FIT_TEXTS = 1_500
MOST_LANGUAGES = 1_000
UNDETERMINED = "und"
CACHE_ROWS = 24_576
BATCH_CHARS = 400_000
#: a cosine of no more than this is no evidence of any learned language
LEAST_SCORE = 0.0
#: about five times 1 / sqrt(DIMENSION), the spread of the cosine of noise and a prototype, as the best of several is taken
NOISE_SCORE = 0.15
#: below this many letters, clean texts too may have cosines like noise
FEW_LETTERS = 30


class Space:
    """Letter and trigram vectors; trigrams lately seen are kept, up to ``CACHE_ROWS``."""

    def __init__(self, dimension: int = DIMENSION, seed: int = 2):
        self.dimension, self.seed = dimension, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.int64)
        self.rows = np.empty((0, dimension), np.int8)
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        """The vector of a code point; 0 stands for whatever is between words."""
        if code not in self.letters:
            if len(self.letters) > 8192:
                self.letters.clear()
            draw = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimension, dtype=np.int8)
            self.letters[code] = (2 * draw - 1).astype(np.int8)
        return self.letters[code]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """A row for each trigram code."""
        parts = [(codes >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
        out = np.ones((len(codes), self.dimension), np.int8)
        for place, part in enumerate(parts):
            names, at = np.unique(part, return_inverse=True)
            rolled = np.stack([np.roll(self.letter(int(c)), 2 - place) for c in names]) if len(names) else out[:0]
            out *= rolled[at]
        return out

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct codes, at most ``CACHE_ROWS``."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        missing = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(missing):
            if len(self.codes) + len(missing) > CACHE_ROWS:
                self.codes, self.rows = codes, self.bind(codes)
            else:
                merged = np.concatenate((self.codes, missing))
                order = np.argsort(merged, kind="stable")
                self.codes, self.rows = merged[order], np.concatenate((self.rows, self.bind(missing)))[order]
            at = np.searchsorted(self.codes, codes)
        return at

    def trigrams(self, text: str | None) -> np.ndarray:
        """Codes of the trigrams of the lower-cased letters, with one gap for each run of anything else."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(self.is_letter[points], points, 0)
        points = np.concatenate(([0], points, [0]))
        points = points[(points != 0) | np.concatenate(([True], points[:-1] != 0))]
        if len(points) < 3:
            return np.empty(0, np.int64)
        if points[-1] != 0:
            points = np.append(points, 0)
        return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A vector for each text; 0 for a text without letters."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        grams = [self.trigrams(t) for t in texts]
        sizes = [len(g) for g in grams]
        if not sum(sizes):
            return out
        codes, at = np.unique(np.concatenate(grams), return_inverse=True)
        kept = self.lookup(codes) if len(codes) <= CACHE_ROWS else None
        begin = 0
        for i, n in enumerate(sizes):
            if n:
                counts = np.bincount(at[begin : begin + n])
                own = np.flatnonzero(counts)
                for k in range(0, len(own), 4096):
                    some = own[k : k + 4096]
                    rows = self.rows[kept[some]] if kept is not None else self.bind(codes[some])
                    out[i] += counts[some].astype(np.float32) @ rows.astype(np.float32)
            begin += n
        return out


_spaces: dict[int, Space] = {}


def space(dimension: int) -> Space:
    if dimension not in _spaces:
        _spaces[dimension] = Space(dimension)
    return _spaces[dimension]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def bounded(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of at most about ``BATCH_CHARS`` characters each."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1] or "") + 32
        if size >= BATCH_CHARS:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def fit_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    usable: Column | None = None,
    texts_per_language: int = FIT_TEXTS,
    dimension: int = DIMENSION,
) -> dict[str, np.ndarray]:
    """Unit prototypes of the ``MOST_LANGUAGES`` most frequent languages at most.

    Rows with a null language, and texts without letters, teach nothing.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(2)).alias("own_hash"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("own_hash").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: max(1, r.n) for r in sizes.collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, texts_per_language / n))])
    # a row repeated any number of times is one row after the partial aggregation
    picked = rows.where(F.pmod("own_hash", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30)).groupBy("lang", "own_hash").agg(F.max("text").alias("text"))

    def run(batches):
        own, sums = space(dimension), {}
        for b in batches:
            names = b.column(0).to_pylist()
            for first, texts in bounded(b.column(1)):
                for name, row in zip(names[first:], unit(own.bundles(texts))):
                    sums[name] = sums.get(name, 0) + row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
            )

    partial = small_batches(picked.select("lang", "text")).mapInArrow(run, "lang string, v array<double>")
    cells = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    found = {r.lang: unit(np.round(np.array([c.x for c in r.v]), 6)) for r in rows}
    return {k: found[k] for k in sorted(found) if found[k].any()}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], *, text_col: str = "text"
) -> DataFrame:
    """The ``keep`` columns of every row, its ``lang_pred`` and its ``score`` (the cosine, at least 0).

    Cases: a null text, one without letters, and every text if nothing was learned, is ``und`` with
    score 0.  Of equal cosines the language first by name wins.  Texts of
    any length count whole; repeated rows get equal results; columns of any name can be kept.  An empty input gives no rows.
    """
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())).astype(np.float32) if names else np.zeros((0, DIMENSION), np.float32)
    chosen, kept, texts_of = with_text(docs, keep, text_col)
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = space(matrix.shape[1])
        for b in batches:
            predicted, scores = [], []
            for _, texts in bounded(texts_of(b)):
                vectors = unit(own.bundles(texts))
                cosines = vectors @ matrix.T
                for v, c in zip(vectors, cosines):
                    best = int(c.argmax()) if len(c) and v.any() else -1
                    predicted.append(names[best] if best >= 0 else UNDETERMINED)
                    scores.append(min(1.0, max(0.0, float(c[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return chosen.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit_languages(docs, usable=fold(4) != 2)
    return identify(docs, prototypes, ["doc_id"]).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
