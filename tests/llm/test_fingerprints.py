import hashlib
import math
import random
import re
import statistics
import struct
from collections import Counter

import xxhash

from quern.llm import fingerprints as fp
from quern.llm.common import table


def grams(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def check(rows, docs):
    """docs: (id, text) in the order of the operator."""
    errors = []
    by_text = {}
    for (_, text), (_, following), r in zip(docs, docs[1:] + docs[:1], rows):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    return errors


def chained(*values):
    """The signed 64-bit hash of words (str), 32-bit (int below 2^31 in a 1-tuple) and 64-bit numbers, each with the hash before it as seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_samples(text):
    """ln a of the least sample in each stratum, one occurrence after the other."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    runs = [words[i : i + fp.GRAM] for i in range(max(1, len(words) - fp.GRAM + 1))] if words else []
    least = {}
    for term, n in Counter(chained(*run) & ((1 << 63) - 1) for run in runs).items():
        first = chained(term, (4,), (0,)) % fp.SLOTS
        turn = chained(term, (6,))
        for slot, weight in Counter(chained(term, (4,), (k,)) % fp.SLOTS if k < fp.DEALT else (turn + k - fp.DEALT) % fp.SLOTS for k in range(n)).items():
            drawn = term if slot == first else chained(term, (5,), (slot,))
            x, y, z = (chained(drawn, (k,)) for k in (1, 2, 3))
            u = lambda bits, shift: (((bits & ((1 << 64) - 1)) >> shift & ((1 << 30) - 1)) + 0.5) * 2.0**-30
            r = -math.log(u(x, 0) * u(x, 30))
            ln_c = math.log(-math.log(u(y, 0) * u(y, 30)))
            t = math.floor(math.log(weight) / r + u(z, 0))
            a = ln_c - r * (t - u(z, 0) + 1)
            least[slot] = min(a, least.get(slot, math.inf))
    return least


def same_samples(fingerprint, least):
    """A fingerprint's strata and digests are those of the samples, up to the last bits of logarithms."""
    found = {int(fingerprint[i : i + 2], 16): int(fingerprint[i + 2 : i + 6], 16) for i in range(0, len(fingerprint), 6)}
    if set(found) != set(least):
        return False
    for slot, a in least.items():
        (bits,) = struct.unpack("<q", struct.pack("<d", a))
        last = int(40 * max(1, 0.25 / abs(a)))  # last bits of the logarithms weigh more where they cancel
        if found[slot] not in {chained(bits + k) & 0xFFFF for k in range(-last, last + 1)}:
            return False
    return True


def plain_likeness(a, b):
    a, b = ({x[i : i + 6] for i in range(0, len(x), 6)} for x in (a, b))
    either = {x[:2] for x in a | b}
    return len(a & b) / len(either) if either else 1.0


def test_whole_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "DEALT", 64)
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 9)
    rng = random.Random(4)
    docs = []
    for i in range(48):
        own = [f"w{rng.randrange(200)}" for _ in range(rng.choice((0, 1, 3, 5, 60, 400)))]
        line = [f"line{i % 5}", "of", "six", "or", "seven", "words"] * rng.choice((0, 0, 3, 50, 200))
        docs.append((3 * i - 20, " ".join(own + line) if i % 7 else None))
    got = sorted(fp.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    for r, (_, text), (_, after), following in zip(got, docs, docs[1:] + docs[:1], got[1:] + got[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert same_samples(r.fingerprint, plain_samples(text)) and same_samples(r.edited_fingerprint, plain_samples(edited))
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == plain_likeness(r.fingerprint, following.fingerprint)


def test_op4_estimates_generalised_jaccard(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    rows = sorted(fp.op4_fingerprints(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    errors = check(rows, docs)
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.06


def test_weights_count(spark):
    """Repeated terms: the collision rate follows the weights, not the set of terms."""
    rows = []
    for i in range(300):
        words = [f"a{i}x{j}" for j in range(40)]
        base, rare = " ".join(words), f"b{i} c{i} d{i} e{i} f{i} "
        rows.append((2 * i, base))
        rows.append((2 * i + 1, base + " " + base + " " + rare))
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    pairs = [(got[2 * i].near_next, jaccard(texts[2 * i], texts[2 * i + 1])) for i in range(300)]
    assert abs(statistics.mean(a - b for a, b in pairs)) < 0.01


def test_heavy_terms_weigh_on_all_strata(spark):
    """Texts dominated by a repeated line: likeness is the generalised Jaccard similarity of the whole texts."""
    rows = []
    for i in range(60):
        rare = " ".join(f"r{i}x{j}" for j in range(104))
        for times in (200, 0, 120, 3000):
            line = f"buy{i} one{i} get{i} one{i}x free{i} " * times
            rows.append((len(rows), line + rare))
    texts = dict(rows)
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(4):
        pairs = [(got[i].near_next, jaccard(texts[i], texts[(i + 1) % len(texts)])) for i in range(k, len(texts), 4)]
        errors = [a - b for a, b in pairs]
        assert abs(statistics.mean(errors)) < 0.02 and statistics.pstdev(errors) < 0.06


def test_heavy_words_weigh_without_bias(spark):
    """Single words, and the same with one word repeated 0.7 times as often as there are words; repeats of a word against more repeats."""
    rows = []
    for n in (40, 150, 1000, 0):
        for i in range(150):
            words = " ".join(f"a{n}x{i}x{j}" for j in range(n or 150))
            few, many = (0, int(0.7 * n)) if n else (304, 904)
            rows += [(len(rows) + k, f"{words} " + f"spam{n}x{i} " * m) for k, m in enumerate((few, many))]
    texts = dict(rows)
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at in range(0, len(rows), 300):
        errors = [got[i].near_next - jaccard(texts[i], texts[i + 1]) for i in range(at, at + 300, 2)]
        assert abs(statistics.mean(errors)) < 0.015 and statistics.pstdev(errors) < 0.06


def test_occurrences_after_the_dealt_ones(spark, monkeypatch):
    """Beyond ``DEALT`` occurrences strata are filled in turn: weights of all strata add up to the occurrences."""
    monkeypatch.setattr(fp, "DEALT", 16)
    rows = [(i, f"w{i // 2} " * (4 + 40 * (1 + i % 2) + i)) for i in range(400)]
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    errors = [got[i].near_next - jaccard(texts[i], texts[i + 1]) for i in range(0, 400, 2)]
    assert abs(statistics.mean(errors)) < 0.02


def test_equal_ids_are_split(spark, monkeypatch):
    """A third of all rows has one id: they lie in many buckets, and the order stays that of (id, hash)."""
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 7)
    for cuts, per_range in ((4096, 20_000), (6, 5)):
        monkeypatch.setattr(fp, "CUTS", cuts)
        monkeypatch.setattr(fp, "ROWS_PER_RANGE", per_range)
        docs = [(50 if i % 3 == 0 else i, f"text number {i} of the list with a few more words {i * 7}") for i in range(300)]
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        hashes = {r.text: r.h for r in frame.selectExpr("text", "shiftrightunsigned(xxhash64(text), 1) h").collect()}
        order = [t for _, t in sorted(docs, key=lambda d: (d[0], hashes[d[1]]))]
        got = fp.with_next(frame, id_col="doc_id", text_col="text").collect()
        assert {r.text: r.next_text for r in got} == dict(zip(order, order[1:] + order[:1]))
        sizes = Counter(r.bucket for r in got if r.doc_id == 50)
        assert len(sizes) > 5 and max(sizes.values()) < 40


def test_buckets_join_up(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 7)
    docs = [(i * i * 10**9, f"text number {i} of the list with a few more words {i * 7}") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(sorted(fp.edited_fingerprints(frame).collect(), key=lambda r: r.doc_id), docs)


def test_ranges_and_null_ids(spark, monkeypatch):
    """More buckets than cuts, and many rows without an id: the order stays that of (id, hash)."""
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(fp, "CUTS", 4)
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(fp, "MOST_HEADS", 3)
    docs = [(None if i % 3 == 0 else i**3 - 50_000, f"text number {i} of the list with a few more words {i * 7}") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = {r.text: r.h for r in frame.selectExpr("text", "shiftrightunsigned(xxhash64(text), 1) h").collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1]]))
    got = fp.with_next(frame, id_col="doc_id", text_col="text").collect()
    assert {r.text: r.next_text for r in got} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])} and len(got) == 100
    assert len({r.bucket for r in got}) > 10 and fp.edited_fingerprints(frame).count() == 100


def test_edge_cases(spark):
    rows = [
        (3, None, "a", 1), (4, "", None, None), (5, "   \n", "x", 2), (6, "one", "x", 2), (7, "One two\tthree", "x", 2),
        (8, "ab é漢字😀 " * 30_000, "x", 2), (9, "one two three four five six", "x", 2),
    ]
    schema = "doc_id long, text string, fingerprint string, bucket int"
    got = sorted(fp.edited_fingerprints(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.doc_id)
    check(got, [(r[0], r[1]) for r in rows])
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == ""
    assert by_id[3].near_next == by_id[4].near_next == 1.0 and by_id[5].near_next == 0.0
    repeated = rows + [(6, "one", "x", 2), (None, "no id", None, None), (None, "no id", None, None)]
    assert fp.edited_fingerprints(spark.createDataFrame(repeated, schema)).count() == len(repeated)
    (alone,) = fp.edited_fingerprints(spark.createDataFrame(rows[-1:], schema)).collect()
    check([alone], [(9, rows[-1][1])])
    assert alone.near_next == 1.0
    assert fp.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
