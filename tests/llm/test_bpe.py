"""The tokenization automaton against the library, an explicit construction, and itself."""

import hashlib
import os
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, queries, token_counts, token_shards, wavelet

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "Hello  world's\tend", "<|endoftext|>Hi<|startoftext|>x<|endoftext|>", "Σίσυφος ΟΔΟΣ", "é İstanbul x́ ÉCOLE", "日本語 テスト 12345 ½²", "don't we'll I'M ''s",
    "a\x1cb \x7f \x00 ​", "a b c　d", "😀👍🏽 ok", "ŉ ǅ ﬁ", "a<b <| |> <|endoftext|x|>", "x" * 300, "\n".join(["line"] * 50),
]


def brute(word, base, merges):
    """Byte-pair encoding by the definition: the best merge first, from left to right."""
    parts, rank = list(word), {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def gadgets(base, merges):
    """The automaton by building all states and arcs: state -> label -> state."""
    states, n = {0: dict.fromkeys(base, 0)}, 1
    for a, b in merges:
        targets = {arcs[a] for arcs in states.values() if a in arcs and b in states[arcs[a]]}
        copies = {}
        for p in targets:
            copies[p] = n
            states[n] = {k: v for k, v in states[p].items() if k != b}
            n += 1
        after = {p: states[p][b] for p in targets}
        for arcs in states.values():
            if arcs.get(a) in copies:
                arcs[a] = copies[arcs[a]]
        for arcs in states.values():
            if a in arcs and arcs[a] in copies.values():
                old = next(p for p, c in copies.items() if c == arcs[a])
                arcs[a + b] = after[old]
    return states


def random_merges(rng, base, size):
    have, merges = list(base), []
    while len(merges) < size:
        a, b = rng.choice(have), rng.choice(have)
        if a + b not in have:
            merges.append((a, b))
            have.append(a + b)
    return merges


def walked(m, words):
    tokens, sizes = m.walk(pa.array([w.encode() for w in words], pa.binary()))
    ends = np.cumsum(sizes)
    return [[m.labels[t] for t in tokens[e - n : e]] for e, n in zip(ends, sizes)]


@pytest.mark.parametrize("least", [1, 1 << 30])  # as arrays, and word by word
@pytest.mark.parametrize("seed", range(12))
def test_automaton(seed, least, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_ARRAY", least)
    rng = random.Random(seed)
    merges = random_merges(rng, "abc", 12)
    m = bpe.MergeAutomaton([*"abc"], merges)
    words = ["", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(200))]
    assert walked(m, words) == [brute(w, "abc", merges) for w in words]
    states = gadgets("abc", merges)
    for word in words[:60]:
        state = 0
        for t in brute(word, "abc", merges):
            state = states[state][t]  # the canonical path exists
    number = {x: i for i, x in enumerate(m.labels)}
    reached, all_arcs = {}, set()
    todo = [(0, None)]
    while todo:
        s, label = todo.pop()
        for w, q in states[s].items():
            if label is not None:
                reached.setdefault(label, set()).add(w)
            if (w, q) not in all_arcs:
                all_arcs.add((w, q))
                todo.append((q, w))
    assert {x for i, x in enumerate(m.labels) if m.live[i]} == {w for w, _ in all_arcs}
    for t in reached:
        ws = [number[w] for w in m.labels if m.live[number[w]]]
        goes = m.follows(np.full(len(ws), number[t]), np.array(ws))
        assert [m.labels[w] for w, g in zip(ws, goes) if g] == [m.labels[w] for w in ws if m.labels[w] in reached[t]], (merges, t)


def ids_of(own, texts):
    return [ids[a:b].tolist() for ids, ends in own.encode(pa.array(texts, pa.string())) for a, b in zip(ends, ends[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_library(texts):
    own, tok = bpe.load(PATH), Tokenizer.from_file(PATH)
    texts = [*texts, *TEXTS, None]
    expected = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(own, texts) == expected
    decoded = [d for ids, ends in own.encode(pa.array(texts, pa.string())) for d in own.decode(ids, ends).to_pylist()]
    assert decoded == [tok.decode(x, skip_special_tokens=False) for x in expected]


def test_every_character():
    own, tok = bpe.load(PATH), Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}B {chr(c)}'{chr(c)}s{chr(c)}" for c in [*range(0x3000), 0xFEFF, 0x1F600] if not 0xD800 <= c < 0xE000]
    texts += ["it's 'tis ''s 's's 'street 'rest 'real'll l'l 'LLx 'Ve", "'", "'s", "'ll've'd'm 'r 'v 'l x'rex"]
    assert ids_of(own, texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_blocks(monkeypatch):
    """Results do not depend on how texts are cut into blocks, and a text of one word of any length is encoded."""
    own, tok = bpe.load(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} Some{i} thing{i * 7}! <|endoftext|> Ünder" for i in range(100)] + [" ".join(f"w{i}" for i in range(300)), "y" * 5000, "abcab" * 700]
    expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 50, 1000):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
        assert ids_of(own, texts) == expected


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", None), (77, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


def test_encode_decode(spark, docs):
    tok = Tokenizer.from_file(PATH)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_digest(bpe.encode_decode(docs, PATH)).collect())
    expected = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        expected.append((str(r.doc_id), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_shards(spark, docs, tmp_path):
    tok = Tokenizer.from_file(PATH)
    manifest = token_shards.write_shards(docs, PATH, 2, f"file://{tmp_path}/s", shard_tokens=40)
    assert manifest.count() > 2
    got = {(r.doc_id, r.start): r.ids for r in token_shards.read_shards(manifest).collect()}
    ties = F.xxhash64(F.coalesce("text", F.lit("")))
    order = sorted(docs.withColumn("tie", ties).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    start = 0
    for r in order:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert bytes(got[r.doc_id, start]) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)
    assert len(got) == len(order)
    empty = token_shards.write_shards(docs.limit(0), PATH, 2, f"file://{tmp_path}/e")
    assert empty.count() == 0 and token_shards.read_shards(empty).count() == 0


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 1), (5, 1), (300_000, 50_000), (1000, 3), (2000, 1 << 20)])
def test_wavelet(tmp_path, n, most):
    rng = np.random.default_rng(n)
    tokens = (rng.random(n) ** 3 * most).astype(np.uint32)
    (tmp_path / "w").write_bytes(wavelet.dump(tokens, [5, None], [n - n // 2, n // 2]))
    with open(tmp_path / "w", "rb") as f:
        w = wavelet.WaveletFile(f)
        assert (w.all() == tokens).all() and w.documents()[0] == [5, None]
        assert w.documents()[1].tolist() == [n - n // 2, n]
        for i in rng.integers(0, n, 30).tolist() if n else []:
            t = int(tokens[i])
            places = np.flatnonzero(tokens == t)
            assert w.access(i) == t and w.count(t) == len(places)
            assert w.count(t, i // 2, i) == int(((places >= i // 2) & (places < i)).sum())
            k = int(rng.integers(0, len(places)))
            assert w.occurrence(t, k) == places[k]
        assert w.count(most + 1) == 0
        with pytest.raises(IndexError):
            w.access(n)


BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    extra = spark.createDataFrame([(100 + i, t, None) for i, t in enumerate([" lead", "a \n b\t c", "a\n\n\nb  \n", "tail ", "two  blanks", "\n", "x<|endoftext|> <|endoftext|>"])], docs.schema)
    both = docs.unionByName(extra)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(both, BYTE).collect())
    assert got == sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


def test_token_count_blocks(monkeypatch):
    monkeypatch.setattr(token_counts, "PACK_DOCS", 3)
    own, tok = token_counts.load(BYTE), Tokenizer.from_file(BYTE)
    block = token_counts._Block(own)
    texts = [*TEXTS, "a a a b", "b a"]
    for i, t in enumerate(texts):
        block.add(i, len(t.encode()), t)
    names, packs = {}, []
    for batch in block.rows(9):
        for r in batch.to_pylist():
            if r["pack"] is None:
                names[r["number"]] = r["pretoken"].decode()
            else:
                packs.append(r["pack"])
    pieces = np.array(own.pieces([names[i] for i in range(len(names))]))
    assert len(packs) == -(-len(texts) // 3) and len(set(names.values())) == len(names)
    got = {i: c for p in packs for i, c in zip(*[token_counts.unpack(p, pieces)[k] for k in (0, 2)])}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
