"""Phrase mining: frequent phrases of bounded length per language, their cohesion, and which of them a longer one stands for.

Each shard of texts gets the suffix automaton of its pieces, bounded at ``MOST_WORDS`` words, built level by level over arrays instead of a word
at a time: a state of level k is a distinct phrase of k words with the number of its end positions; its transition comes from the state of
the phrase less its last word, its suffix link leads to that of the phrase less its first one.  A level is built from pairs of neighbouring states
of the level below.  Before the next level, shards exchange hashes and counts, and states whose count over all shards can't reach
``LEAST`` go, so that no shard enumerates extensions of rare phrases; a collision only lets some rare phrase through, since what is left is counted
exactly, by its words, at the end.

A phrase is dropped if a longer candidate that contains it has nearly its count.  The longer ones one word away, whose suffix link or prefix
it is, suffice: whatever holds them both occurs no more often than they do.

Cases: a null or empty text has no words; a null language is ``und``.  Phrases don't pass ends of pieces or texts.  Repeated rows count each.  Texts of any
length are taken whole, one with more than ``SHARD_BYTES`` as a shard of its own.  Equal scores go by count, then by the phrase's bytes.  Other columns are ignored, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import shards
from quern.llm.common import dropped, small_batches, table

LEAST = 30
MOST_WORDS = 4
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
SHARD_BYTES = 4 << 20
#: first cut of each language's best: tasks among which its phrases are dealt
DEAL = 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: ends of pieces become line ends, tabs blanks
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: rows of spelled phrases that are handed on at once
SPELL_ROWS = 1 << 15
#: names, n and parts are byte planes (see ``shards.planes``); words hold no line end, which parts them; langs are in the order of their states
STATE = "shard long, langs array<struct<lang: string, states: long, words: long>>, names binary, keys binary, n binary, words binary, parts binary"


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(31))) * _MIX[0] + b
    out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    return out ^ (out >> np.uint64(32))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
    """(ids of all words in order, -1 at ends of pieces and texts; the distinct words)."""
    pieces = b"\n".join(texts).lower().translate(_ENDS).replace(b"\n", b" \n ")
    ids, words = shards.token_ids(pieces)
    real = np.array([w not in (b"", b"\n") for w in words], bool)
    ids = np.where(real, np.cumsum(real) - 1, np.where([w == b"\n" for w in words], -1, -2)).astype(np.int32)[ids]
    return ids[ids > -2], [w.decode() for w, r in zip(words, real) if r]


def first_level(by_lang: dict[str, list[bytes]]) -> Level:
    """The states of single words, all of them, and the state at each place."""
    places, keys, langs, words, total = [], [], [], [], 0
    for lang, texts in by_lang.items():
        ids, own = word_ids(texts)
        places += [np.where(ids >= 0, ids + total, -1).astype(np.int32), np.array([-1], np.int32)]
        total += len(own)
        words += own
        langs.append((lang, len(own), int((ids >= 0).sum())))
        salt = pd.util.hash_array(np.array([lang], object), categorize=False)
        keys.append(combined(pd.util.hash_array(np.array(own, object), categorize=False), salt) if own else np.empty(0, np.uint64))
    names = np.concatenate(places)
    return Level(names, np.concatenate(keys), np.bincount(names[names >= 0], minlength=total), langs, pa.array(words, pa.string()), np.arange(total, dtype=np.int32)[None])


def parted(blob: pa.Buffer, n: int) -> pa.Array:
    """The ``n`` strings that line ends part in ``blob``, without a Python string each."""
    if not n:
        return pa.array([], pa.string())
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data == 10)
    offsets = np.concatenate(([0], ends - np.arange(len(ends)), [len(data) - len(ends)])).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def joined(words: pa.Array) -> pa.Buffer:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_buffer()


def words_of(words: pa.Scalar, parts: pa.Scalar, states: int) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, the places among them of each state's first word, second, and so on)."""
    places = shards.unplaned(parts.as_buffer(), np.int32).reshape(-1, states) if states else np.empty((1, 0), np.int32)
    return parted(words.as_buffer(), int(places.max()) + 1 if states else 0), places


class Level:
    """A level of a shard's automaton: the state at each place, and each state's key, count and words; states of a language are neighbours."""

    def __init__(self, names: np.ndarray, keys: np.ndarray, n: np.ndarray, langs: list[tuple[str, int, int]], words: pa.Array | None, parts: np.ndarray | None):
        self.names, self.keys, self.n, self.langs, self.words, self.parts = names, keys, n, langs, words, parts

    @classmethod
    def of(cls, b: pa.RecordBatch, i: int, spell: bool) -> Level:
        read = lambda j, kind: shards.unplaned(b.column(j)[i].as_buffer(), kind)
        langs = [(x["lang"], x["states"], x["words"]) for x in b.column(1)[i].as_py()]
        n = read(4, np.int64)
        words, parts = words_of(b.column(5)[i], b.column(6)[i], len(n)) if spell else (None, None)
        return cls(read(2, np.int32), np.frombuffer(b.column(3)[i].as_buffer(), np.uint64), n, langs, words, parts)

    def _langs(self, of: np.ndarray) -> list[tuple[str, int, int]]:
        """The languages with the number of states among ``of``, places of states in ascending order."""
        ends = np.cumsum([0, *(states for _, states, _ in self.langs)])
        return [(lang, int(n), words) for (lang, _, words), n in zip(self.langs, np.diff(np.searchsorted(of, ends)))]

    def next(self) -> Level:
        """States of phrases one word longer: ``parent`` is the state less the last word, ``link`` that less the first."""
        a, b = self.names[:-1], self.names[1:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        pair = a[at].astype(np.int64) * max(1, len(self.keys)) + b[at]
        order = np.argsort(pair)
        ranked = pair[order]
        del pair
        fresh = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
        names = np.full(len(self.names), -1, np.int32)
        names[at[order]] = np.cumsum(fresh) - 1
        parent, link = np.divmod(ranked[fresh], max(1, len(self.keys)))
        n = np.diff(np.append(np.flatnonzero(fresh), len(ranked)))
        parts = None if self.parts is None else np.concatenate((self.parts[:, parent], self.parts[-1:, link]))
        return Level(names, combined(self.keys[parent], self.keys[link]), n, self._langs(parent), self.words, parts)

    def only(self, kept: np.ndarray) -> Level:
        renamed = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype(np.int32)  # -1 finds the last
        parts = self.parts[:, kept]
        used = np.zeros(len(self.words), bool)
        used[parts.ravel()] = True
        parts = (np.cumsum(used, dtype=np.int32) - 1)[parts] if parts.size else parts
        return Level(renamed[self.names], self.keys[kept], self.n[kept], self._langs(np.flatnonzero(kept)), self.words.filter(pa.array(used, pa.bool_())), parts)

    def row(self, shard: int) -> pa.RecordBatch:
        langs = pa.array([[{"lang": lang, "states": states, "words": words} for lang, states, words in self.langs]], pa.list_(pa.struct([("lang", pa.string()), ("states", pa.int64()), ("words", pa.int64())])))
        blobs = shards.planes(self.names), np.ascontiguousarray(self.keys), shards.planes(np.asarray(self.n, np.int64)), joined(self.words), shards.planes(self.parts.ravel())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), langs, *[shards.one_blob(x) for x in blobs]], names=["shard", "langs", "names", "keys", "n", "words", "parts"])


def encoded(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """The first level of every shard."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, defaultdict(list), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if text:
                    held[lang].append(text)
                    size += len(text)
                if size >= SHARD_BYTES:
                    yield first_level(held).row(shard)
                    shard, held, size = shard + 1, defaultdict(list), 0
        if held:
            yield first_level(held).row(shard)

    return shards.settled(small_batches(rows).mapInArrow(run, STATE), "words", **shards.FEW_BLOBS)


def reaches(least: int):
    """Keys whose counts add up to ``least``."""

    def decide(columns: list[np.ndarray], shard: np.ndarray) -> np.ndarray:
        order = np.argsort(columns[0])
        ranked = columns[0][order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        out = np.empty(len(ranked), bool)
        out[order] = np.repeat(np.add.reduceat(columns[1][order], starts) >= least, np.diff(np.append(starts, len(ranked))))
        return out

    return decide


def _levels(batches: Iterator[pa.RecordBatch], first: bool, spell: bool):
    for b in batches:
        for i in range(b.num_rows):
            own = Level.of(b, i, spell)
            own = own if first else own.next()  # the level below is let go
            yield b, i, own


def spelled(level: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, k, n): a row for each state of each shard, some thousand spelled at a time."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                langs, n = b.column(0)[i].as_py(), shards.unplaned(b.column(1)[i].as_buffer(), np.int64)
                words, parts = words_of(b.column(2)[i], b.column(3)[i], len(n))
                names, of = pa.array([x["lang"] for x in langs], pa.string()), np.repeat(np.arange(len(langs)), [x["states"] for x in langs])
                for first in range(0, len(n), SPELL_ROWS):
                    own = slice(first, first + SPELL_ROWS)
                    spelling = [words.take(pa.array(p[own])) for p in parts]
                    phrase = pc.binary_join_element_wise(*spelling, " ") if k > 1 else spelling[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[own], pa.int64())), phrase, pa.array(np.full(len(phrase), k, np.int32)), pa.array(n[own], pa.int64())], names=["lang", "phrase", "k", "n"])

    return shards.byte_batches(level.select("langs", "n", "words", "parts")).mapInArrow(run, "lang string, phrase string, k int, n long")


def pruned(below: DataFrame, buckets: int, least: int, first: bool) -> DataFrame:
    """The level above ``below`` (or ``below`` itself) less the states that are rare over all shards."""

    def send(batches):
        for b, i, level in _levels(batches, first, False):
            order = np.argsort(level.keys)
            keys = level.keys[order]
            yield shards.sent(b.column(0)[i].as_py(), shards.bucket_edges(keys, buckets), [keys, level.n[order].astype(np.int64)])

    answers = shards.answered(shards.byte_batches(below.drop("words", "parts")).mapInArrow(send, shards.sent_schema(2)), ["<u8", "<i8"], reaches(least), "counts")

    def keep(batches):
        for b, i, level in _levels(batches, first, True):
            order = np.argsort(level.keys)
            kept = np.empty(len(order), bool)
            kept[order] = shards.answers(b.column(7)[i], shards.bucket_edges(level.keys[order], buckets))
            yield level.only(kept).row(b.column(0)[i].as_py())

    return shards.settled(below.join(answers.hint("shuffle_hash"), "shard", "left").mapInArrow(keep, STATE), "level", **shards.FEW_BLOBS)


def frequent_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of 1 to ``most`` words that occurs ``least`` times or more, and (lang, n) of all words; both written."""
    words = encoded(docs, lang_col, text_col)
    sizes = shards.settled(words.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.words").alias("n")), "sizes")
    tokens = words.agg(F.sum(F.octet_length("names"))).first()[0] or 0
    buckets = shards.bucket_count(4 * tokens)
    found, below = None, words
    for k in range(1, most + 1):
        level = pruned(below, buckets, least, k == 1)
        dropped(below)  # at most two levels are on disk
        counts = spelled(level, k).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        part = shards.settled(counts, "phrases")
        found, below = part if found is None else found.unionByName(part), level
    dropped(below)
    return found, sizes


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the candidates, by their loosest cut."""
    some = found.where("k > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("front"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    of = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = parts.join(of("front", "l"), ["lang", "front"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    loosest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c")
    return both.groupBy("lang", "phrase", "k", "a").agg(loosest).select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score")


def not_covered(candidates: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates without a longer one, a word away, that has ``percent`` of their count."""
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substr(phrase, instr(phrase, ' ') + 1)")))
    covers = candidates.where("k > 2").select("lang", inner.alias("phrase"), F.col("a").alias("cover")).groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    covered = F.expr(f"cast(cover as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {percent}")
    return candidates.join(covers, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("cover")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    found, sizes = frequent_phrases(docs, lang_col=lang_col, text_col=text_col, least=least, most=most)
    left = not_covered(scored(found), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # a language's phrases are many: the best of each part first, so that at most DEAL x top meet in a task
    dealt = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).withColumn("place", place("lang", "deal")).where(F.col("place") <= top)
    best = dealt.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(ws) >= {k}" for k in range(1, MOST_WORDS + 1)
    )
    front = "array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')"
    rest = "array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')"
    return rf"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
parts AS MATERIALIZED (SELECT c.lang, c.phrase, a, cut, {front} AS front, {rest} AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c),
fronts AS MATERIALIZED (SELECT p.*, x.f AS l FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.front),
cuts AS (SELECT p.*, y.f AS r, ({SCALE}::HUGEINT * a) // (l + y.f)::HUGEINT AS score FROM fronts p JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
loosest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + w - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - w + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS w FROM c))
  ) t ON s.lang = t.lang AND s.phrase = t.phrase AND 100::HUGEINT * t.a >= {COVERED_PERCENT}::HUGEINT * s.a),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM loosest ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN n USING (lang) WHERE rank <= {TOP}"""
