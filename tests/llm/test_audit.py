"""Source divergence, periodic runs and exact dedup on small tables, against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, exact_dedup, periodic, queries, runtime

# Source divergence


def audit_by_hand(rows, min_docs):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        docs = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: collections.Counter(t for _, x, ts in own for t in ts if x == s and t in kept) for s in {w[1] for w in own}}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(shares[s][t] - q[t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


COLUMNS = "doc_id bigint, text string, lang string, source string, term string, n int"


def test_divergence(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ab", "ÄB", "zß", "日本", "q" * 40) for b in "cdefgh"]
    rows = [(r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s1", "s2", "s3", None]), r.choice([" ", "-", "1", "\u0007", "_"]).join(r.choices(vocabulary[: r.randint(2, 30)], k=r.randint(0, 60)))) for _ in range(400)]
    rows += [("en", "s4", None), ("en", "s5", "12 34"), ("fr", "only", "un"), ("xx", "a", "rare"), ("xx", "b", ""), ("en", "s1", "Ab" * 3 + " ABc " * 9000), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, t, lang, s, "clash", 1) for i, (lang, s, t) in enumerate(rows)], COLUMNS)
    for cells in (divergence.CELLS, 7):  # one block, and many
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = divergence.audit(docs.repartition(5), 30).collect()
        assert len(got) == len(audit_by_hand(rows, 30)) and {tuple(x) for x in got} == audit_by_hand(rows, 30)
    assert {tuple(x) for x in divergence.audit(docs, 10**6).collect()} == audit_by_hand(rows, 10**6)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_terms_are_grouped_by_xxh64(monkeypatch):
    for size in range(1, 32):
        rows = np.random.default_rng(size).integers(0, 256, (50, size), dtype=np.uint8)
        assert divergence.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(x.tobytes()) for x in rows]
    texts = pa.array(["Ab", "ab cd", "", "cd1ab", "é" * 30 + " " + "é" * 30, "x" * 50 + "-" + "X" * 50])
    want = [b"ab", b"ab", b"cd", b"cd", b"ab", "é".encode() * 30, "é".encode() * 30, b"x" * 50, b"x" * 50]
    for weak in (False, True):  # with a hash on which everything collides, bytes alone tell
        if weak:
            monkeypatch.setattr(divergence, "xxh64", lambda m: np.zeros(len(m), np.uint64))
            monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", lambda _: 0)
        for kind in (pa.string(), pa.large_string()):
            data, starts, ends, of = divergence.boundaries(texts.cast(kind))
            number, names = divergence.grouped(data, starts, ends)
            assert [names[i] for i in number] == want and of.tolist() == [0, 1, 1, 3, 3, 4, 4, 5, 5] and len(names) == 4


def test_shares_are_exact():
    total = 9 * 10**15 - 10**6
    counts = np.array([0, 1, 12345678901234, total])
    assert divergence.shares(counts, total, 1000).tolist() == [1 + 10**9 * (c + 5) // (total + 5000) for c in counts.tolist()]
    with pytest.raises(OverflowError):
        divergence.shares(counts, 2**63 // 1000, 0)


# Periodic runs


def runs_by_hand(words):
    out, n = [], len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                s, e = i, j + p
                if e - s >= max(24, 3 * p) and all(any(words[x] != words[x + q] for x in range(s, e - q)) for q in range(1, p)):
                    out.append((s, e - s, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(3)
    some = 0
    for k in range(400):
        words = [r.randint(0, r.choice([0, 1, 2, 9])) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            block = [r.randint(0, r.choice([0, 1, 5])) for _ in range(r.randint(1, 14))]
            inner = block * r.randint(1, 6) + block[: r.randint(0, len(block))]
            words[(at := r.randint(0, len(words))) : at] = inner * r.choice([1, 1, 3])
        want = runs_by_hand(words)
        some += len(want)
        assert periodic.runs(np.array(words, np.int64)) == want, words
    assert some > 150


def test_runs_in_small_parts(monkeypatch):
    monkeypatch.setattr(periodic, "PROBES", 10)
    words = [0, 1, 2] * 9 + [5] * 30 + [0, 1] * 20 + [7, 0, 1, 1] * 8
    assert periodic.runs(np.array(words)) == runs_by_hand(words)


def test_long_texts_take_no_square_of_time():
    n, r = 300_000, np.random.default_rng(1)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    begin = time.time()
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.runs(np.tile(np.arange(1000), n // 1000)) == [(0, n, 1000)]
    assert periodic.runs(np.tile([*[1] * 29, 2], n // 30))[0] == (0, 29, 1)
    periodic.runs(r.integers(0, 2, n // 10))
    periodic.runs(np.array(fib[-1]))
    assert time.time() - begin < 60


def test_detect_runs(spark):
    rows = [(1, "a b " * 20, "x"), (2, None, "x"), (3, "", "x"), (4, " \t x\x0b", "x"), (1, "a b " * 20, "x"), (None, "w " * 30, "x"), (5, " ".join(map(str, range(100))), "x"), (6, "p q r " * 8 + "z " + "y " * 24, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = {r.doc_id: r for r in periodic.detect_runs(docs).collect()}
    assert periodic.detect_runs(docs).count() == 8 and periodic.detect_runs(docs.limit(0)).count() == 0
    assert [tuple(x) for x in got[6].runs] == [(0, 24, 3), (25, 24, 1)] and tuple(got[6].best) == (25, 24, 1) and got[6].collapsed == "p q r z y"
    assert got[1].collapsed == "a b" and tuple(got[None].best) == (0, 30, 1) and got[2].best is None and got[3].collapsed == "" and got[4].collapsed == " x"


def op12_by_hand(rows):
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        yield (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000).select("doc_id", "text")
    more = spark.createDataFrame([(5000, None), (5001, ""), *((6000 + i, " ".join(["one two three"] * (8 + i % 5)) + f" {i} four") for i in range(60))], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(op12_by_hand(rows), key=lambda r: r[0])
    assert sum(r[1] > 0 for r in got) > 60


# Exact dedup


def dedup_by_hand(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for body, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        left = 1
        for doc_id, text in own:
            kept = (doc_id, len(text)) == (keep[0], len(keep[1])) and left > 0
            left -= kept
            out.append((doc_id, keep[0], len(own), kept, body))
    return collections.Counter(out)


def copies(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "é", "é", "a b", "ab", "A B", "long " * 20_000, *(f"text number {i} of some words" for i in range(n // 6))]
    rows = []
    for i in range(n):
        t = r.choice(texts) if r.random() < 0.6 else "hot text here"
        if t and r.random() < 0.5:
            t = re.sub(" ", lambda _: r.choice([" ", "  ", "\n", "\x0b\t", ""]), t)
        rows.append((r.choice([i, i, i, i + 10_000, None, -i, 7, -(2**63), 2**63 - 1]), t))
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, monkeypatch, weak):
    """With three generations, several buckets and, if weak, digests that most texts share."""
    monkeypatch.setattr(exact_dedup, "BUCKET", 20)
    rows = copies(2, 300)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, digest string, points int")
    digest = (lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 1))) if weak else exact_dedup.sha256
    of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(3))
    for most in (exact_dedup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
        snapshots = []
        for g in range(3 if most else 2):
            snapshots.append(exact_dedup.admit(docs.where(of == g) if most else docs.where((of > 0) == (g > 0)), runtime.shared_path(spark, "t"), snapshots, digest))
        got = exact_dedup.resolve(snapshots).select("doc_id", "keep_id", "group_size", "kept").collect()
        want = collections.Counter()
        for k, n in dedup_by_hand(rows).items():
            want[k[:4]] += n
        assert collections.Counter(map(tuple, got)) == want
        if not weak:
            break


def test_exact_dedup_query_columns(spark, tmp_path):
    rows = copies(4, 200)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    want = collections.Counter()
    for k, n in dedup_by_hand(rows).items():
        want[(*k[:4], hashlib.sha256(k[4].encode()).hexdigest())] += n
    assert collections.Counter(map(tuple, got)) == want
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.dedup(empty).count() == 0


def test_fuse_filter():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 40_000):
        keys = r.integers(-(2**63), 2**63 - 1, n)
        f = exact_dedup.Fuse.of(np.concatenate([keys, keys[: n // 2]]))
        assert f.maybe(keys).all() and len(f.prints) < 1.3 * n + 300
        assert f.maybe(r.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 0.006


def test_screen_is_exact(spark):
    old = exact_dedup.admit(spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), runtime.shared_path(spark, "t"))
    asked = spark.range(4000, 9000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"))
    assert exact_dedup.screen(asked, old).count() == 1000
    nothing = exact_dedup.admit(spark.createDataFrame([], "doc_id bigint, text string"), runtime.shared_path(spark, "t"))
    assert exact_dedup.screen(asked, nothing).count() == 0


# Bounds and wide offsets of the operators before


def test_toxicity_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    """Five labelled ids, each with thousands of rows and texts."""
    from ledgerloom.llm import toxicity

    docs = spark.range(100_000).select((F.col("id") % 5).alias("doc_id"), F.concat_ws(" ", F.lit("words of"), F.when(F.col("id") % 5 < 2, "bad").otherwise("good"), (F.col("id") % 2000).cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(5)], "doc_id bigint, toxic int")
    rows = toxicity._sample(docs, labels, ["toxic"], 50)
    runtime.ship(spark)
    assert rows.count() == 50 and rows.select("doc_id", "version").distinct().count() == 50
    assert toxicity._sample(docs, labels, ["toxic"], 3).count() == 3
    monkeypatch.setattr(toxicity, "CELLS", 60)
    assert 3 <= toxicity._bounded(runtime.table(rows, "t")).count() < 20
    chain = toxicity.train(docs, labels, ["toxic"], 200)
    assert toxicity.score(spark.createDataFrame([(1, "bad bad")], "doc_id bigint, text string"), chain).count() == 1


def test_wide_offsets_give_the_same(spark, tmp_path):
    texts = [None, "", "é a B c", "one two three four five six", " x  y ", "word " * 40]
    narrow, wide = pa.array(texts, pa.string()), pa.array(texts, pa.large_string())
    for table in (None, runtime.byte_table(), runtime.byte_table([*range(48, 58), *range(97, 123)])):
        for a, b in ((narrow, wide), (narrow.slice(2, 3), wide.slice(2, 3))):
            x, y = runtime.words(a, table), runtime.words(b, table)
            assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist() and x[2] == y[2]
    with pytest.raises(TypeError):
        runtime.parts(pa.array([1]))
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(18)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [f"op{n}" for n in (1, 2, 3, 4, 7, 8, 9, 11, 12, 13)]
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] in names:
            found = []
            for large in ("false", "true"):
                spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", large)
                try:
                    found.append(sorted(map(repr, query(spark, str(tmp_path)).collect())))
                finally:
                    spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
            assert found[0] == found[1] and found[0], name
