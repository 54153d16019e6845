"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Each fingerprint is stored under its segments and looks up the small
Hamming ball around them; of two that differ in one bit, the one with the bit set looks up the other, so
only set bits are cleared.  Matches are verified on the complete distance.

``near_duplicates`` links 64-bit fingerprints exactly: with radius ``r`` and ``m`` segments, ``r < 2 m``, two
fingerprints within ``r`` bits agree on some segment up to one bit, and for all but the first
``r - m + 1`` segments they need to agree exactly.

``similar_documents`` links texts by the Jaccard similarity of their word 5-grams.  Fingerprints of 256 bits,
of word pairs, find candidates: a text that differs in some words keeps nearly all its pairs, so candidates
stay close.  Candidates of a component are then compared by their 5-grams, without any cap.

Bucket sizes are counted before rows are moved; buckets over ``BLOCK`` fingerprints, and components over
``TEXTS`` texts, are dealt to pairs of blocks.  A task emits a spanning forest of the links it verifies, never
all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import hot_keys, lookup_join, small_batches, table, written
from quern.llm.components import components

BLOCK = 4096
SMALL = 24
SEED = 42

#: ``similar_documents``: words a shingle and similarity of a link; words, lanes, segments and radius of the candidates' fingerprints
SHINGLE, SIMILARITY = 5, 0.8
PAIR, LANES, SEGMENT_BITS, RADIUS = 2, 4, 24, 40
#: texts, and characters, of a block of a component
TEXTS, CHARS = 512, 8 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, which makes of a hash another one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_lanes(text: str | None, words_per_shingle: int = 4, lanes: int = 1) -> np.ndarray:
    """SimHash of the word shingles' XXH64, and of hashes made of it, 64 bits each; 0 if there are no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = (ends[-n:] if len(words) >= words_per_shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    counts = np.zeros((lanes, 64), np.int64)
    for k in range(0, n, 4096):
        some = hashes[k : k + 4096]
        for lane in range(lanes):
            own = _mixed(some + np.uint64(lane)) if lane else some
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    return int(fingerprint_lanes(text, words_per_shingle)[0])


def _lanes(lanes: int) -> list[str]:
    return ["fp", *[f"fp{i}" for i in range(1, lanes)]]


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, lanes: int = 1, more: dict[str, Column] | None = None
) -> DataFrame:
    """(doc_id, ``more``, fp, fp1, ...) of every row; lanes are the signed views of 64 bits of the fingerprint each."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in (more or {}).items()], F.col(text_col).alias("text"))
    kept = len(chosen.columns) - 1

    def run(batches):
        for b in batches:
            found = np.array([fingerprint_lanes(t.as_py(), words_per_shingle, lanes) for t in b.column(kept)], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(kept)] + [pa.array(np.ascontiguousarray(found[:, i])) for i in range(lanes)],
                names=[*b.schema.names[:kept], *_lanes(lanes)],
            )

    schema = T.StructType(chosen.schema.fields[:kept] + [T.StructField(n, T.LongType()) for n in _lanes(lanes)])
    return small_batches(chosen).mapInArrow(run, schema)


def segments(radius: int, count: int) -> list[tuple[str, int, int, int]]:
    """(lane, first bit, width, ball radius) of each segment of a 64-bit fingerprint."""
    if not 0 <= radius < 2 * count or not 0 < count <= 64:
        raise ValueError("the radius must be below twice the number of segments")
    q, a = divmod(radius, count)
    edges = [64 * i // count for i in range(count + 1)]
    return [("fp", lo, hi - lo, q if i <= a else q - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def wide_segments(lanes: int = LANES, bits: int = SEGMENT_BITS) -> list[tuple[str, int, int, int]]:
    """Segments of ``bits`` bits of a fingerprint of several lanes, each with a ball of one bit."""
    return [(name, lo, bits, 1) for name in _lanes(lanes) for lo in range(0, 64 - bits + 1, bits)]


def index_entries(nodes: DataFrame, parts: list[tuple[str, int, int, int]]) -> DataFrame:
    """(key, probe, node): each node under the segments of its fingerprint, and as a probe under their balls."""
    arrays = []
    for s, (lane, lo, width, ball) in enumerate(parts):
        if ball < 0:
            continue
        mask = (1 << width) - 1
        bits = F.shiftrightunsigned(lane, lo).bitwiseAND(F.lit(mask)) if width < 64 else F.col(lane)
        base = bits.bitwiseOR(F.lit(s << 56))
        own = F.array(F.struct(base.alias("key"), F.lit(False).alias("probe")))
        if ball:
            single = F.filter(F.array(*[F.lit(1 << b) for b in range(width)]), lambda b: bits.bitwiseAND(b) != 0)
            own = F.concat(own, F.transform(single, lambda b: F.struct(base.bitwiseXOR(b).alias("key"), F.lit(True).alias("probe"))))
        arrays.append(own)
    return nodes.select("node", F.explode(F.concat(*arrays)).alias("e")).select("e.key", "e.probe", "node")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the edges (u, v)."""
    names, both = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _large_group(node: np.ndarray, fp: np.ndarray, probe: np.ndarray, side: np.ndarray, radius: int) -> tuple[list, list]:
    """Verified links that span the group's components; rows of one side only meet the other side, if there are two."""
    u, v, label = [], [], np.arange(len(node))
    two = side.any() and not side.all()
    for i in range(len(node)):
        ok = label != label[i]
        if probe[i]:
            ok &= ~probe
        if two:
            ok &= side != side[i]
        found = np.flatnonzero(ok)
        found = found[_distance(fp[found], fp[i]) <= radius]
        if len(found):
            near, first = np.unique(label[found], return_index=True)
            u += [node[i]] * len(near)
            v += node[found[first]].tolist()
            label[np.isin(label, near)] = label[i]
    return u, v


def verify_groups(key: np.ndarray, node: np.ndarray, fp: np.ndarray, probe: np.ndarray, side: np.ndarray, radius: int):
    """Spanning links among rows of equal key (sorted by key): at least one row of a link isn't a probe."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    small = size[group] <= SMALL
    u, v = [], []
    rows = np.flatnonzero(small)
    for d in range(1, SMALL):
        rows = rows[rows + d < len(key)]
        rows = rows[group[rows] == group[rows + d]]
        if not len(rows):
            break
        hit = rows[~(probe[rows] & probe[rows + d])]
        hit = hit[_distance(fp[hit], fp[hit + d]) <= radius]
        u.append(node[hit])
        v.append(node[hit + d])
    for g in np.flatnonzero(size > SMALL):
        at = slice(start[g], start[g] + size[g])
        a, b = _large_group(node[at], fp[at], probe[at], side[at], radius)
        u.append(np.array(a, np.int64))
        v.append(np.array(b, np.int64))
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
    other = u != v  # a node may be in a group more than once
    return stars(u[other], v[other]) if other.any() else (u[:0], v[:0])


def _block_pairs(rows: DataFrame, keys: list[str], blocks: Column, own: Column) -> DataFrame:
    """``rows`` dealt to pairs of blocks of their key: adds deal, lo, hi (the blocks) and side."""
    paired = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return paired.select("*", F.xxhash64(*keys, lo, hi).alias("deal"), lo.alias("lo"), hi.alias("hi"), (F.col("own") > F.col("other")).alias("side"))


def _by_deal(batches, limit: int):
    """Tables of whole deals (the first column, which is sorted), of about ``limit`` bytes or one deal each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            whole = pa.Table.from_batches(held).combine_chunks()
            deals = whole.column(0).to_numpy()
            cut = int(np.searchsorted(deals, deals[-1]))  # sorted as signed; the last deal may go on
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b)], names=["a", "b"])


def near_links(nodes: DataFrame, parts: list[tuple[str, int, int, int]], radius: int) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs of nodes within ``radius`` bits that meet in a segment.

    ``nodes`` has a column node (long, distinct) and lanes; if node is the only lane, it's the fingerprint.
    """
    lanes = [c for c in nodes.columns if c != "node"] or ["node"]
    named = nodes if lanes != ["node"] else nodes.withColumn("fp", F.col("node"))
    entries = index_entries(named, parts)
    sizes = (
        entries.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("stored"))
        .where("n > 1 and stored > 0")
        .select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    sizes = written(sizes, "bucket-sizes")
    met = lookup_join(entries, sizes, "key", hot=hot_keys(sizes, "key", least=BLOCK))
    if lanes != ["node"]:
        met = met.join(nodes.hint("merge"), "node")
    dealt = (
        _block_pairs(met, ["key"], F.col("blocks"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
        .repartition("deal")
        .sortWithinPartitions("deal", "key", "lo", "hi")
        .select("deal", "node", "probe", "side", *[c for c in lanes if c != "node"])
    )
    wide = lanes != ["node"]

    def run(batches):
        for whole in _by_deal(batches, 8 << 20):
            key, node = (whole.column(i).to_numpy() for i in (0, 1))
            probe, side = (whole.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
            fp = np.stack([whole.column(i).to_numpy() for i in range(4, whole.num_columns)], axis=1) if wide else node[:, None]
            yield _links(*verify_groups(key, node, fp.view(np.uint64), probe, side, radius))

    return dealt.mapInArrow(run, "a long, b long")


def near_components(fps: DataFrame, *, radius: int = 4, count: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``fps`` (doc_id, fp).

    component_id is the least doc_id reachable over links within ``radius`` bits; rows with a null
    doc_id link like any others, and a component of nothing but such rows has a null component_id.
    """
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    links = near_links(nodes.select(F.col("fp").alias("node")), segments(radius, count), radius)
    return _with_components(fps, nodes, "fp", links).select("doc_id", "fp", "component_id")


def _with_components(rows: DataFrame, nodes: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``rows`` with component_id, the least ``least`` of all ``nodes`` that ``links`` join with the row's node."""
    roots = components(links)
    linked = nodes.select(F.col(node).alias("node"), "least").join(roots.hint("merge"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    least = written(least, "least-ids")
    named = lookup_join(linked.drop("least"), least, "root", hot=hot_keys(least, "root")).select(F.col("node").alias(node), "component")
    known = nodes.join(named.hint("merge"), node, "left").select(node, "n", F.coalesce("component", "least").alias("component_id"))
    known = written(known, "components")
    return lookup_join(rows, known, node, hot=hot_keys(known, node))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 4,
    radius: int = 4,
    count: int = 3,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Cases: a null, empty or blank text has fingerprint 0 and links like any other; a text shorter
    than a shingle is one shingle; texts of any length are taken whole; repeated rows and ids give
    one row each; other columns are ignored; an empty input gives no rows.
    """
    found = fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle)
    return near_components(written(found, "doc-fingerprints"), radius=radius, count=count)


def shingle_sets(texts: list[str | None], words_per_shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted; a shorter text is one shingle, none without words."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
        n = max(1, len(words) - words_per_shingle + 1) if words else 0
        codes = np.full(n, min(len(words), words_per_shingle), np.uint64)
        for k in range(min(len(words), words_per_shingle)):
            codes = _mixed(codes * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        out.append(np.unique(codes))
    return out


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of which sets have a Jaccard similarity of at least ``similarity``; two empty sets have 1."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts[at] > 1
    column = (np.cumsum(counts > 1) - 1)[at[shared]]  # elements of one set alone don't count
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((n, min(4096, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    either = sizes[:, None] + sizes[None, :] - common
    return (common >= similarity * either - 1e-9) & ((sizes[:, None] > 0) == (sizes[None, :] > 0))


def similar_links(texts: DataFrame, *, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that span the graph of similar nodes in each group of ``texts`` (node, root, n, text_chars, text).

    All texts of a group (root) are compared; n and text_chars are the group's numbers of texts and characters.
    """
    blocks = F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("text_chars") / CHARS)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    dealt = _block_pairs(texts, ["root"], blocks, own).repartition("deal").sortWithinPartitions("deal", "root", "lo", "hi").select("deal", "node", "side", "text")

    def run(batches):
        for whole in _by_deal(batches, 4 << 20):
            deal, node = (whole.column(i).to_numpy() for i in (0, 1))
            side = whole.column(2).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1], [True])))
            u, v = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo > 1:
                    sets = shingle_sets(whole.column(3).slice(lo, hi - lo).to_pylist(), words_per_shingle)
                    found = np.triu(similar_pairs(sets, similarity), 1)
                    if side[lo:hi].any() and not side[lo:hi].all():
                        found &= side[lo:hi, None] != side[None, lo:hi]
                    i, j = np.nonzero(found)
                    u.append(node[lo + i])
                    v.append(node[lo + j])
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
            if len(u):
                yield _links(*stars(u, v))

    return small_batches(dealt).mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``: the least id of those that similar texts connect.

    Texts are similar if the sets of their word 5-grams have a Jaccard similarity of 0.8 or more and their
    fingerprints meet in the index.  Two of similarity 0.8 differ in about a tenth of a fingerprint's bits and
    meet with a probability of about 0.93; equal texts always do.

    Cases: null, empty and blank texts are similar to each other and to nothing else; a text of fewer
    words than a shingle is one shingle; rows of equal text are one text; rows of equal ids are rows of their own;
    texts of any length are compared whole; other columns are ignored; an empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", F.lit(0)).otherwise(F.xxhash64(text))
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=PAIR, lanes=LANES, more={"node": node}), "doc-fingerprints")
    lanes = _lanes(LANES)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in lanes])
    nodes = written(nodes, "texts")
    candidates = written(components(near_links(nodes.select("node", *lanes), wide_segments(), RADIUS)), "candidates")
    # copies go in the partial aggregation, before any text is moved
    texts = docs.select(node.alias("node"), text.alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    members = written(texts.join(candidates.hint("merge"), "node").select("root", "node", "text"), "candidate-texts")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("text_chars"))
    sizes = written(sizes, "candidate-sizes")
    links = similar_links(lookup_join(members, sizes, "root", hot=hot_keys(sizes, "root")))
    return _with_components(rows.select("doc_id", "node"), nodes, "node", links).select("doc_id", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
