"""URL filter, WARC, line dedup, decontamination, repetition and toxicity on small tables, against brute force."""

import base64
import collections
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_dedup, queries, repetition, toxicity, url_filter, warc

DOCS = "doc_id bigint, text string, spans string, version int"


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)


# URL filter


def test_urls(spark):
    urls = [
        ("https://WWW.Shop.Example.COM/en/7?x=1#f", "allow"), ("http://a.example.com/en/1", "block"), ("http://example.com", "allow"), ("http://x.net/de/8", "allow"), ("http://example.net/de/8/9", "block"), ("http://my.org/es/", "block"),
        ("http://com/en/", "block"), ("http://xcom/en/", "allow"), (None, "allow"), ("no scheme", "allow"), ("http://listed.io/a/?b=2&a=1&utm_source=z#q", "block"), ("http://www.listed.io/a?a=1&b=2", "block"), ("http://listed.io/b", "allow"), ("", "allow"), ("://", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, (u, _) in enumerate(urls)] + [(1, urls[1][0], "x", "y")], "page_id bigint, url string, host string, rule string")
    listed = spark.createDataFrame([("listed.io/a?a=1&b=2",), (None,), ("listed.io/a?a=1&b=2",)] + [(f"other{i}.io/",) for i in range(300)], "url string")
    got = url_filter.filter_urls(pages, listed).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert r.verdict == urls[r.page_id][1], urls[r.page_id]
    by = {r.page_id: r for r in got}
    assert (by[0].host, by[0].path, by[0].rule) == ("www.shop.example.com", "/en/7", "example.com/en/7")
    assert (by[8].host, by[8].path, by[9].host, by[14].host) == ("", "", "", "") and by[2].path == ""
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0)).where("rule IS NULL").collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negative_and_few_false_positives(spark, monkeypatch):
    listed = spark.range(4000).select(F.concat(F.lit("h.io/"), "id").alias("url"))
    pages = spark.range(8000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.io/"), "id").alias("url"))
    for most in (1 << 19, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", most)
        got = url_filter.filter_urls(pages, listed, []).groupBy((F.col("page_id") < 4000).alias("in_list"), "maybe", "verdict").count().collect()
        n = {(r.in_list, r.maybe, r.verdict): r["count"] for r in got}
        assert n[True, True, "block"] == 4000 and n.get((False, True, "allow"), 0) < 80
        assert not any(k[0] and not k[1] for k in n)


# WARC


def test_warc(spark, tmp_path):
    big, small = "é" * 60, "tiny"
    rows = [(5, "http://a/\r\nX: y", big, "c"), (2, None, big, "c"), (9, "http://b/é", big, "c"), (3, "u", small, "c"), (4, "u", small, "c"), (6, "u", None, "c"), (7, "u", "", "c"), (8, "u", "x" * 300_000, "c"), (2, None, big, "c"), (None, "u", big, "c"), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    warc.archive_pages(pages, folder)
    back = warc.read_archives(spark, folder).collect()
    assert len(back) == len(rows)
    first = {hashlib.sha256(big.encode()).hexdigest(): "urn:page:2"}
    for r in back:
        html = next((h or "" for p, _, h, _ in rows if f"urn:page:{'' if p is None else p}" == r.record_id))
        digest = hashlib.sha256(html.encode()).hexdigest()
        revisit = digest in first and r.record_id != first[digest]
        assert (r.record_type, r.payload_digest, r.payload_bytes) == ("revisit" if revisit else "response", digest, len(html.encode()))
        assert r.refers_to == (first[digest] if revisit else None)
        assert (r.payload is None) if revisit else (bytes(r.payload) == html.encode())
    df = warc.read_archives(spark, folder, "record_id string, record_type string").where("record_type = 'revisit' AND record_id LIKE 'urn:page:9%'")
    assert [r.record_id for r in df.collect()] == ["urn:page:9"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan
    warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_foreign_archives(tmp_path):
    data = [warc.record(f"id{i}", "response", "http://x", hashlib.sha256(b"h" * (5 + i)).hexdigest(), 5 + i, None, b"h" * (5 + i)) for i in range(4)]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "plain.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "own.warc.gz").write_bytes(b"".join(map(warc.member, data)))
    whole = b"".join(data)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(whole))  # all records in a member
    (tmp_path / "mixed.warc.gz").write_bytes(warc.member(data[0] + data[1]) + gzip.compress(data[2][:100]) + gzip.compress(data[2][100:]) + warc.member(data[3]) + b"\0" * 9)
    from ledgerloom.llm.runtime import open_fs

    for name in ("plain.warc", "plain.warc.gz", "own.warc.gz", "whole.warc.gz", "mixed.warc.gz"):
        for payload in (True, False):
            fs, path = open_fs(str(tmp_path / name))
            with fs.open_input_file(path) as f:
                got = list(warc.records(f, lambda r: r["record_id"] != "id2", payload))
            assert [r["record_id"] for r in got] == ["id0", "id1", "id3"]
            assert [r["payload"] for r in got] == ([b"h" * 5, b"h" * 6, b"h" * 8] if payload else [None] * 3)
            assert [r["payload_bytes"] for r in got] == [5, 6, 8]
    assert gzip.decompress((tmp_path / "own.warc.gz").read_bytes()) == b"".join(data)
    reader = warc.WarcReader("x", None)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1 and reader._want({"record_type": "response"}) and not reader._want({"record_type": "revisit"})


def test_digests_and_long_records(tmp_path):
    body = random.Random(1).randbytes(3_000_000)
    for digest, good in ((hashlib.sha256(body).hexdigest(), True), ("0" * 64, False)):
        data = [warc.record("a", "response", "u", digest, len(body), None, body), warc.record("b", "revisit", "u", digest, 3_000_000, "a", b"")]
        for name, raw in (("p", b"".join(data)), ("g", gzip.compress(b"".join(data))), ("m", b"".join(map(warc.member, data)))):
            (tmp_path / name).write_bytes(raw)
            with pa.OSFile(str(tmp_path / name)) as f:
                if good:
                    got = list(warc.records(f))
                    assert [r["payload_bytes"] for r in got] == [3_000_000] * 2 and got[0]["payload"] == body and got[1]["payload"] is None
                else:
                    with pytest.raises(warc.Damaged):
                        list(warc.records(f))
                    assert len(list(warc.records(f, payload=False))) == 2
    assert not warc._digests_differ("sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode(), b"x") and not warc._digests_differ("new:1", b"x")


def test_damaged_archives(spark, tmp_path):
    """Whatever is cut off or changed is an error or still the whole result, never a shorter one."""
    rng = random.Random(2)
    bodies = [rng.randbytes(900) for _ in range(3)]
    data = [warc.record(f"id{i}", "response", "u", hashlib.sha256(b).hexdigest(), 900, None, b) for i, b in enumerate(bodies)]
    whole = [{"id": f"id{i}", "body": b} for i, b in enumerate(bodies)]

    def read(raw, payload=True):
        return [{"id": r["record_id"], "body": r["payload"]} for r in warc.records(pa.BufferReader(raw), payload=payload)]

    for raw, marks in (
        (b"".join(data), [0, *np.cumsum([len(d) for d in data])]),
        (gzip.compress(b"".join(data)), []),
        (b"".join(map(gzip.compress, data)), [0, *np.cumsum([len(gzip.compress(d)) for d in data])]),
        (b"".join(map(warc.member, data)), [0, *np.cumsum([len(warc.member(d)) for d in data])]),
    ):
        assert read(raw) == whole
        for cut in range(1, len(raw)):
            for payload in (True, False):
                try:
                    got = read(raw[:cut], payload)
                except warc.Damaged:
                    continue  # else it ends between records, or among the line ends after one
                assert any(cut == m or raw[:1] == b"W" and m - 4 <= cut < m for m in marks), cut
                assert len(got) == sum(m - 4 * (raw[:1] == b"W") <= cut for m in marks[1:])
        for _ in range(60):  # a flipped bit in a payload
            at = raw.find(bodies[1][100:110]) if raw[:2] != b"\x1f\x8b" else len(raw) // 2
            bad = bytearray(raw)
            bad[at + rng.randrange(9)] ^= 1 << rng.randrange(8)
            with pytest.raises(warc.Damaged):
                read(bytes(bad))
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.warc.gz").write_bytes(gzip.compress(b"".join(data))[:-30])
    with pytest.raises(Exception, match=r"a\.warc\.gz"):
        warc.read_archives(spark, f"file://{tmp_path}/x").collect()


# line dedup


def brute_lines(texts):
    first, out = {}, []
    for d, text in enumerate(texts):
        lines = text.split("\n")
        solid = [(i, x.strip(" \t\r")) for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(solid) - 2):
            key = tuple(x for _, x in solid[k : k + 3])
            place = first.setdefault(key, (d, k))
            if place != (d, k):
                low = max(k, place[1] + 3) if place[0] == d else k
                gone |= {solid[j][0] for j in range(low, k + 3)}
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b ", "\tc", "", "d", "e"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", "a", "a\nb", "z\n" * 9, "q\nr\ns\nt", "x\nq\nr \ns\nt\ny"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [got[i].text for i in range(len(texts))] == brute_lines(texts)
    assert got[63].text == "z\nz\nz\n" and got[65].text == "x\ny" and got[65].removed == [1, 2, 3, 4] and got[65].n_lines == 6
    odd = spark.createDataFrame([(1, None), (2, "m\nn\no"), (2, "m\nn\no"), (None, "m\nn\no"), (3, "m\nn\no")], "doc_id bigint, text string")
    out = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(odd).collect())
    assert out == [("1", None), ("2", ""), ("2", ""), ("3", ""), ("None", "m\nn\no")]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    carried = line_dedup.dedup_lines(table(spark, ["a"]), carry=["spans"]).first()
    assert carried.carried.spans == "clash"


# decontamination


def brute_hits(texts, items):
    out = []
    for text in texts:
        w, hit, of = decontaminate.words_of((text or "").encode()), set(), set()
        for item, t in items:
            iw = decontaminate.words_of((t or "").encode())
            size = min(13, len(iw))
            for i in range(max(1, len(iw) - 12) if iw else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == iw[i : i + size]:
                        hit |= set(range(p, p + size))
                        of |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOOM_WORDS, 1])  # with one word nearly everything passes the filter
def test_contamination(spark, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "the", "é1", "X"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 20, 0, 13])] + [(11, None), (None, "b b the"), (5, "the the the X")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(25)] + [t for _, t in items] + ["pre, " + items[6][1].upper() + "! post", "", None]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, doc_id string")
    docs = table(spark, texts)
    got = {r.doc_id: r for r in decontaminate.verdicts(decontaminate.find_contamination(docs, bench, block)).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].items_sha256) for i in range(len(texts))] == brute_hits(texts, items)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.values())
    twice = docs.unionByName(docs.where("doc_id < 3"))
    assert decontaminate.find_contamination(twice, bench, block).count() == len(texts) + 3
    assert decontaminate.verdicts(decontaminate.find_contamination(docs, bench.limit(0), block)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(docs.limit(0), bench, block).count() == 0


# repetition


def brute_repeats(text, least):
    w = text.split()
    n = len(w)

    def covered(k):
        c = collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = max([k for k in range(least, n) if len({tuple(w[i : i + k]) for i in range(n - k + 1)}) < n - k + 1], default=0)
    return n, covered(3), covered(least), longest


def test_repetition():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab cd ef g".split()) for _ in range(rng.randint(0, 80))).encode() for _ in range(80)] + [b"", b"x", b"x x x x x x x x", b"t " * 300]
    texts += [b"a b c " * 40, b"p " * 90 + b"q " + b"p " * 70, b" ".join([b"u v w x y z"] * 9 + [b"k"] + [b"v w x y z u"] * 7)]
    for least in (4, 10):
        m = repetition.measure(pa.array([t.decode() for t in texts]), least)
        of, *flat = m["repeats"]
        for i, t in enumerate(texts):
            assert (m["n_words"][i], m["n_repeat_words"][i], m["covered"][i], m["longest"][i]) == brute_repeats(t, least), t
            w = t.split()
            for start, size, times in zip(*(x[of == i] for x in flat)):
                places = [j for j in range(len(w) - size + 1) if w[j : j + size] == w[start : start + size]]
                assert len(places) == times > 1
                assert len({w[j + size] if j + size < len(w) else j for j in places}) > 1 and len({w[j - 1] if j else -1 for j in places}) > 1


def test_repetition_of_one_word_is_linear():
    import tracemalloc

    text = pa.array(["word " * 400_000])
    tracemalloc.start()
    m = repetition.measure(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (m["n_words"][0], m["covered"][0], m["longest"][0], len(m["repeats"][0])) == (400_000, 400_000, 399_999, 399_990)
    assert peak < 120 * 400_000


def test_repetition_table(spark):
    texts = ["One two\n\n one two\nOne two\nOne two", None, "", "é#* <b>| x", " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(110))] * 2), "a b c d"]
    got = {r.doc_id: r for r in repetition.judge(repetition.measure_repetition(table(spark, texts))).collect()}
    assert (got[0].n_words, got[0].n_dup_lines, got[0].word_chars) == (8, 2, 24)
    assert (got[1].n_words, got[1].kept, got[2].n_words) == (0, False, 0)
    assert (got[3].n_words, got[3].n_symbols, got[3].word_chars) == (2, 5, 9)  # a no-break space does not separate
    assert got[4].kept and not got[4].base_failed and got[5].base_failed and not got[5].kept and got[5].longest == 110
    assert [(r.words, r.times) for r in got[5].repeats] == [(110, 2)] and got[6].n_words == 3
    assert repetition.measure_repetition(table(spark, []).limit(0)).count() == 0


def test_repetition_limits_decide_alone(spark):
    def text(passages, least):  # each passage twice, the rest of the words different
        parts = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate(passages)]
        rest = [f"u{i}" for i in range(least - 2 * sum(passages))]
        cut = len(rest) // 2
        return " ".join([w for p in parts for w in [*p, f"s{p[0]}"]] + rest[:cut] + [w for p in reversed(parts) for w in [*p, f"t{p[0]}"]] + rest[cut:])

    texts = [text([45] * 3, 600), text([12], 100), text([51], 2000), text([50], 2000), text([10], 300)]
    got = {r.doc_id: r for r in repetition.judge(repetition.measure_repetition(table(spark, texts))).collect()}
    assert not any(r.base_failed for r in got.values()) and [got[i].longest for i in range(5)] == [45, 12, 51, 50, 10]
    assert 100 * got[0].covered > 40 * got[0].n_words and 10 * got[2].covered < got[2].n_words
    assert [got[i].kept for i in range(5)] == [False, False, False, True, True]


# toxicity


def brute_chain(texts, labels, steps):
    """The chain by dense matrices: probabilities of all texts from models of all of them, and out-of-fold ones."""
    import re

    def names(t):
        w = set(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
        return w | {x.decode()[: toxicity.BEGINNING].encode() + b"*" for x in w if len(x.decode()) > toxicity.BEGINNING}

    x0 = np.zeros((len(texts), 1 << toxicity.BITS))
    for i, t in enumerate(texts):
        for f in names(t):
            x0[i, toxicity._number(f)] = 1

    def fit(x, extra, y):
        n1, n0, has, n = y.sum(), len(y) - y.sum(), x[y > 0].sum(0), x.sum(0)
        value = np.abs(np.log((has + 0.5) / (n1 + 1)) - np.log((n - has + 0.5) / (n0 + 1))) * (n > 0)
        a = np.hstack([x * value, extra, np.ones((len(y), 1))])
        share = np.where(y > 0, 1 / (2 * n1), 1 / (2 * n0))
        v = np.append(np.where(n > 0, 1.0, 0.0), np.ones(extra.shape[1] + 1))
        for _ in range(8):
            v = a.T @ (share * (a @ v))
            v /= np.linalg.norm(v)
        rate = 1 / (0.3 * np.linalg.norm(a.T @ (share * (a @ v))) + toxicity.RIDGE)
        w = z = np.zeros(a.shape[1])
        keep = np.append(np.ones(a.shape[1] - 1), 0)
        for k in range(steps):
            p = 1 / (1 + np.exp(-(a @ z)))
            new = z - rate * (a.T @ (share * (p - y)) + toxicity.RIDGE * keep * z)
            z, w = new + k / (k + 3) * (new - w), new
        return lambda x, extra: 1 / (1 + np.exp(-(np.hstack([x * value, extra, np.ones((len(x), 1))]) @ w)))

    fold = np.arange(len(texts)) % toxicity.FOLDS
    inside, outside = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    for k in range(labels.shape[1]):
        y, out = labels[:, k], np.zeros(len(texts))
        for f in range(toxicity.FOLDS):
            out[fold == f] = fit(x0[fold != f], outside[fold != f], y[fold != f])(x0[fold == f], outside[fold == f])
        whole = fit(x0, outside, y)
        inside = np.hstack([inside, whole(x0, inside)[:, None]])
        outside = np.hstack([outside, out[:, None]])
    return inside, outside


def test_chain_against_dense_matrices(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 9)
    rng = np.random.default_rng(1)
    words = [f"Word{i}é" for i in range(25)] + ["bad", "badness", "badminton", "o'k"]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(90)] + ["", None]
    first = np.array([("bad" in (t or "").split()) for t in texts])
    labels = np.stack([first, first & np.array(["badness" in (t or "") for t in texts])], axis=1).astype(float)
    labels[0], labels[1], labels[2], labels[3] = 1, 1, 1, 1
    at, bounds = toxicity.features(pa.array(texts))
    chain = toxicity.Chain(("a", "b")).fit(toxicity.Rows(at, bounds, np.zeros((len(texts), 0))), labels)
    inside, outside = brute_chain(texts, labels, toxicity.STEPS)
    assert np.allclose(chain.predict(at, bounds), inside, atol=1e-3)  # single precision
    clean = np.sort(outside[labels[:, 1] == 0, 1])[::-1]
    assert np.isclose(chain.threshold, max(toxicity.LEAST, clean[0]), atol=1e-3)
    assert len(chain.models[1].earlier) == 1 and chain.models[1].earlier[0] > 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = queries.category_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.where(~held), queries.CATEGORIES)
    scored = toxicity.score(docs, chain).join(labels.where(held), "doc_id").select((F.col("probabilities")[1] >= chain.threshold).alias("p"), "toxic").collect()
    print(chain.threshold, sum(r.p and not r.toxic for r in scored) / len(scored), sum(r.p and r.toxic for r in scored) / sum(r.toxic for r in scored))
    assert sum(r.p and not r.toxic for r in scored) <= 0.005 * len(scored)
    assert sum(r.p and r.toxic for r in scored) >= 0.85 * sum(r.toxic for r in scored)


def test_toxicity_edges(spark):
    docs = table(spark, ["bad word", None, "", "nice word"])
    none = spark.createDataFrame([], "doc_id bigint, junk int, toxic int")
    chain = toxicity.train(docs, none, queries.CATEGORIES)
    out = toxicity.score(docs, chain)
    assert out.columns == ["doc_id", "text", "spans", "version", "probabilities"]
    assert {tuple(r.probabilities) for r in out.collect()} == {(0.0, 0.0)}
    some = spark.createDataFrame([(0, 0, 1), (3, 0, 0), (0, 0, 0), (9, 1, 1), (1, None, 1)], "doc_id bigint, junk int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, some, queries.CATEGORIES)).count() == 4
    assert toxicity.score(docs.limit(0), chain).count() == 0
