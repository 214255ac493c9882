"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

**Automaton.** Merging ``u v -> w`` is a gadget on a deterministic automaton whose
arcs are tokens and whose paths are the canonical tokenizations. At first there is
one state and an arc for each base symbol. The gadget for ``(u, v)`` (1) makes the
state that ``u`` arcs reach anew without its ``v`` arc, (2) adds a ``w`` arc to
each state that keeps a ``u`` arc, leading where ``v`` led. By induction all arcs
of one label reach one state, so a state is named by the last token.

**Table.** A state made for ``w`` is a copy of the one that its right part reached, and
an arc ``w`` is a copy of the one for its left part, each as of that gadget. So what
gadget ``(u, v)`` removes is removed from each state later copied from ``u``'s and for
each arc later copied from ``v``'s. With arcs numbered down the tree of left parts
(younger copies first) these arcs are an interval. A row of the transition table is
the state's own removed intervals and those it inherits, without what lies inside
others; an arc that is in none of them leaves the state. All 49k rows together are
about 0.7 million intervals, and a transition is one binary search.

**Encoding** looks for the one path of arcs that spells a word: a trie gives the arcs
that spell what comes next, longest first, and the table says which of them leave the
state. Many words take these steps together, as arrays. **Decoding** emits the labels
of the arcs.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

#: Bytes of text that a worker encodes together, and the number of words from which they are walked as arrays.
BLOCK_BYTES, LEAST_ARRAY = 10_000_000, 48
#: The mark that ends a word, as a symbol beside the bytes.
END = 256


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The visible character for each byte, as byte-level vocabularies write them: printable Latin-1 stays, the rest counts up from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


@lru_cache(maxsize=1)
def _symbol_bytes() -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(byte_symbols())}


def to_bytes(label: str) -> bytes:
    """The bytes that a label of visible characters stands for."""
    return label.encode() if label.isascii() else label.translate(_symbol_bytes()).encode("latin-1")


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]``, one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    at += np.repeat((starts - ends + sizes).astype(at.dtype), sizes)
    return values[at]


class PairTable:
    """A hash table from non-negative 31-bit keys to integers, probed by arrays; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = 32 - max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << 32 - self.shift) - 1
        self.keys = np.full(self.mask + 1, -1, np.int32)
        keys = keys.astype(np.int32)
        self.values = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(self.shift)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & np.int32(self.mask)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class MergeAutomaton:
    """The automaton of a merge list over ``base`` symbols; tokens are numbered base first, then merges.

    Labels are written in visible characters for bytes. ``end``: the mark of labels
    that end a word; without one every label may.
    """

    def __init__(self, base: list[str], merges: list[tuple[str, str]], end: str = "") -> None:
        self.labels = [*base, *(a + b for a, b in merges)]
        number = {s: i for i, s in enumerate(self.labels)}
        if len(number) != len(self.labels):
            raise ValueError("two merges make the same token")
        nothing = [-1] * len(base)
        self.left = np.array(nothing + [number[a] for a, _ in merges], np.int32)
        self.right = np.array(nothing + [number[b] for _, b in merges], np.int32)
        self.rank = np.array(nothing + list(range(len(merges))), np.int32)
        self._compile()
        self._trie(end)

    def _compile(self) -> None:
        """The rows of the transition table."""
        n, first = len(self.labels), int((self.rank < 0).sum())
        self.n = n
        copies: list[list[int]] = [[] for _ in range(n)]  # of arcs, younger first
        for w in range(n - 1, first - 1, -1):
            copies[self.left[w]].append(w)
        place, after, count = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for root in range(first):
            stack = [root]
            while stack:
                x = stack.pop()
                if x < 0:
                    after[~x] = count
                    continue
                place[x] = count
                count += 1
                stack.append(~x)
                stack += reversed(copies[x])
        # The interval that each gadget removes: its arc v and the copies made of it from that gadget on.
        young = [[first - 1 - x for x in some] for some in copies]
        low, high = place[self.right[first:]], np.empty(n - first, np.int64)
        for r, v in enumerate(self.right[first:].tolist()):
            k = bisect_right(young[v], -1 - r)
            high[r] = after[copies[v][k - 1]] if k else place[v] + 1
        # A state has its own gadgets' intervals, and those of the states it is copied from, as of then.
        by = np.argsort(self.left[first:], kind="stable")
        key = self.left[first:][by].astype(np.int64) * n + by
        states, sources, before = np.arange(n), np.arange(n), np.full(n, n, np.int64)
        rows, removed = [], []
        while len(states):
            at = np.searchsorted(key, sources * n)
            sizes = np.searchsorted(key, sources * n + np.minimum(before, n - 1)) - at
            rows.append(np.repeat(states, sizes))
            removed.append(gather(by, at, sizes))
            before, sources = self.rank[sources].astype(np.int64), self.right[sources].astype(np.int64)
            more = sources >= 0
            states, sources, before = states[more], sources[more], before[more]
        row, gadget = np.concatenate(rows), np.concatenate(removed)
        wide = n + 1
        start, stop, rank = row * wide + low[gadget], row * wide + high[gadget], gadget
        order = np.lexsort((-stop, start))
        start, stop = start[order], stop[order]
        reach = np.maximum.accumulate(stop)
        apart = np.flatnonzero(start[1:] > reach[:-1]) + 1 if len(start) else np.zeros(0, np.int64)
        kind = np.uint32 if n * wide < 1 << 32 else np.int64  # small tables stay in a processor's cache
        self.place, self.wide = place.astype(kind), kind(wide)
        self.row_start = (start[np.concatenate([[0], apart])] if len(start) else start).astype(kind)
        self.row_stop = (reach[np.append(apart, len(start)) - 1] if len(start) else stop).astype(kind)
        # An arc lives if both its parts do and its left part's state still had the arc of its right part.
        live = np.ones(n, bool)
        own = place[self.right[first:]] + self.left[first:].astype(np.int64) * wide
        at = np.searchsorted(start, own, "right")
        early = np.zeros(n - first, bool)
        left = np.arange(n - first)
        rank = rank[order]
        while len(left):  # through the intervals that begin before the arc, as long as an outer one reaches it
            at[left] -= 1
            left = left[(at[left] >= 0)]
            inside = (stop[at[left]] > own[left]) & (start[at[left]] <= own[left])
            early[left[inside & (rank[at[left]] < left)]] = True
            left = left[~early[left] & (reach[at[left]] > own[left])]
        for r in range(n - first):
            live[first + r] = live[self.left[first + r]] and live[self.right[first + r]] and not early[r]
        self.live = live

    def follows(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Whether each arc leaves each state."""
        key = states.astype(self.place.dtype) * self.wide + self.place[arcs]
        at = np.searchsorted(self.row_start, key, "right") - 1
        return (at < 0) | (self.row_stop[np.maximum(at, 0)] <= key) if len(self.row_stop) else np.ones(len(key), bool)

    def _trie(self, end: str) -> None:
        """The labels of live arcs by byte; those that end a word have ``END`` after their bytes."""
        arcs: list[tuple[bytes, bool, int]] = []
        for i in np.flatnonzero(self.live).tolist():
            x = self.labels[i]
            if not end:
                arcs += [(to_bytes(x), False, i), (to_bytes(x), True, i)]
            elif x.endswith(end):
                arcs.append((to_bytes(x[: len(x) - len(end)]), True, i))
            else:
                arcs.append((to_bytes(x), False, i))
        arcs = [a for a in arcs if a[0]]
        self.arc_token = np.array([a[2] for a in arcs], np.int32)
        self.arc_size = np.array([len(a[0]) for a in arcs], np.int32)
        self.arc_final = np.array([a[1] for a in arcs], bool)
        child: dict[int, int] = {}
        nodes, arc_at, parent, node_of = 1, [-1], [-1], []  # fewer than 2 ** 22 nodes
        for i, (label, final, _) in enumerate(arcs):
            node = 0
            for b in (*label, END) if final else label:
                node, up = child.setdefault(node << 9 | b, nodes), node
                if node == nodes:
                    nodes += 1
                    arc_at.append(-1)
                    parent.append(up)
            arc_at[node] = i
            node_of.append(node)
        best = list(arc_at)
        for node in range(1, nodes):  # parents come first
            if best[node] < 0:
                best[node] = best[parent[node]]
        self.longest_at = np.array(best, np.int32)
        self.shorter = np.array([best[parent[x]] for x in node_of], np.int32)
        self.child = PairTable(np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))

    def _longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest arc that spells what comes at each place; -1 for none."""
        node = np.zeros(len(at), np.int32)
        left, depth = np.arange(len(at)), 0
        while len(left):
            here = at[left] + depth
            symbol = np.where(here < end[left], data[np.minimum(here, len(data) - 1)], np.int32(END))
            down = self.child.get(node[left] << 9 | symbol)
            go = down >= 0
            left = left[go]
            node[left] = down[go]
            left = left[here[go] < end[left]]
            depth += 1
        return self.longest_at[node]

    def walk(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words (a binary array), one word after another, and the number of each word's tokens.

        Long arcs are tried first. Whatever path of existing arcs reaches a place is the
        canonical tokenization of what is before it, so there is one, and a place that
        leads nowhere is never tried again. An empty word has no tokens.
        """
        offsets, data = runtime.parts(words)
        offsets = offsets.astype(np.int64)
        start, end = offsets[:-1], offsets[1:]
        base = int(offsets[0])
        room = int(offsets[-1]) - base
        path = np.zeros(room, np.int32)  # arcs, from each word's first byte on
        dead = np.zeros(room + 1, bool)
        dead[end - base] = True  # the mark of the end must be read, too
        size = np.zeros(len(words), np.int64)
        left = np.flatnonzero(end > start)
        at, last = start.copy(), np.full(len(words), -1, np.int64)
        arc = np.full(len(words), -1, np.int64)
        arc[left] = self._longest(data, at[left], end[left])
        while len(left):
            if len(left) < LEAST_ARRAY:
                for i in left.tolist():
                    self._finish(i, data, int(start[i]), int(end[i]), base, int(at[i]), int(arc[i]), path, dead, size)
                break
            a = arc[left]
            none = a < 0
            if none.any():  # back to the place before, and on to a shorter arc
                back = left[none]
                if not size[back].all():
                    raise ValueError("a word has bytes that no arc spells")
                dead[at[back] - base] = True
                size[back] -= 1
                was = path[start[back] - base + size[back]]
                at[back] -= self.arc_size[was]
                arc[back] = self.shorter[was]
                last[back] = np.where(size[back] > 0, path[start[back] - base + size[back] - 1], -1)
                a = arc[left]
                none = a < 0
            some = left[~none]
            a = a[~none]
            to = at[some] + self.arc_size[a]
            final = self.arc_final[a]
            good = final | ~dead[to - base]
            check = np.flatnonzero(good & (last[some] >= 0))
            good[check] = self.follows(self.arc_token[last[some[check]]], self.arc_token[a[check]])
            bad = some[~good]
            arc[bad] = self.shorter[a[~good]]
            went, a, to, final = some[good], a[good], to[good], final[good]
            path[start[went] - base + size[went]] = a
            size[went] += 1
            at[went] = to
            last[went] = a
            on = went[~final]
            arc[on] = self._longest(data, at[on], end[on])
            done = np.zeros(len(words), bool) if len(left) * 8 > len(words) else None
            if done is not None:
                done[went[final]] = True
                left = left[~done[left]]
            else:
                left = np.setdiff1d(left, went[final], assume_unique=True)
        return self.arc_token[gather(path, start - base, size)], size

    def _finish(self, i: int, data: np.ndarray, start: int, end: int, base: int, at: int, arc: int, path: np.ndarray, dead: np.ndarray, size: np.ndarray) -> None:
        """The rest of one word's way, step by step."""
        arcs, rows, stops = self._scalar()
        word, n = data[start:end].tobytes(), int(size[i])
        while True:
            while arc >= 0:
                to, final = at + arcs[0][arc], arcs[1][arc]
                if final or not dead[to - base]:
                    if not n:
                        break
                    key = int(self.arc_token[path[start - base + n - 1]]) * int(self.wide) + int(self.place[self.arc_token[arc]])
                    k = bisect_right(rows, key) - 1
                    if k < 0 or stops[k] <= key:
                        break
                arc = arcs[2][arc]
            if arc >= 0:
                path[start - base + n] = arc
                n += 1
                at = to
                if final:
                    break
                arc = self._spelt(word, at - start)
            else:
                if not n:
                    raise ValueError("a word has bytes that no arc spells")
                dead[at - base] = True
                n -= 1
                was = int(path[start - base + n])
                at -= arcs[0][was]
                arc = arcs[2][was]
        size[i] = n

    def _scalar(self) -> tuple:
        if not hasattr(self, "_lists"):
            self._lists = ((memoryview(self.arc_size), memoryview(self.arc_final), memoryview(self.shorter)), memoryview(self.row_start), memoryview(self.row_stop))
        return self._lists

    def _spelt(self, word: bytes, at: int) -> int:
        """The longest arc that spells what comes at a place of one word."""
        table, node = self.child, 0
        keys, values, n = table.keys, table.values, len(word)
        while at <= n:
            key = node << 9 | (word[at] if at < n else END)
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> table.shift
            while (there := keys[slot]) != key and there >= 0:
                slot = slot + 1 & table.mask
            if there < 0:
                break
            node = int(values[slot])
            at += 1
        return int(self.longest_at[node])


#: Kinds of bytes in a plain piece: letters, digits, others.
_KIND = np.array([1 if b >= 128 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
#: Bytes by which a piece is not plain: control characters, and what begins characters but the letters U+00C0 to U+024F.
_ODD = np.array([b < 0x20 or b == 0x7F or b == 0xC2 or b >= 0xCA for b in range(256)])


def _any_in(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether any flag is set in each of the runs that follow each other."""
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return before[offsets[1:]] > before[offsets[:-1]]


class WordBpe:
    """The tokenizer of a ``.json`` file whose words end in an end-of-word mark and whose white space is dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or model["dropout"]:
            raise ValueError("a BPE model with an end-of-word mark, without unknown token and dropout, is needed")
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.automaton = MergeAutomaton([s for s in vocab if s not in made], merges, mark)
        single = self.automaton.arc_size == 1
        if sum(single & self.automaton.arc_final) < 256 or sum(single & ~self.automaton.arc_final) < 256:
            raise ValueError("the vocabulary must hold every byte, inside and at the end of a word")
        ids = np.array([vocab[s] for s in self.automaton.labels], np.int64)
        del self.automaton.labels
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        label = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.path, self.most_id = path, max(label)
        self.kind = np.uint16 if self.most_id < 65536 else np.uint32
        self.ids = ids.astype(self.kind)
        #: What each id decodes to, and a blank; nothing for ids that are not in use.
        self.shown = pa.array([label[i] + " " if i in label else "" for i in range(self.most_id + 1)], pa.large_string())
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _odd_words(self, piece: str) -> list[bytes | int]:
        """The words of any piece, as the library normalises and splits it, and the ids of added tokens in it."""
        tok, out = self.library(), []
        for part in self._special.split(piece) if self._special else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [to_bytes(w) for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))]
        return out

    def _odd(self, pieces: pa.Array, lowered: pa.Array) -> np.ndarray:
        """Which pieces hold more than printable ASCII and the letters U+00C0 to U+024F, or an added token."""
        offsets, data = runtime.parts(pieces)
        after = np.append(data[1:], 0) if len(data) else data
        dotted = (data == 0xC4) & (after == 0xB0)  # its lower case is two characters
        low_offsets, low = runtime.parts(lowered)
        after = np.append(low[1:], 0) if len(low) else low
        signs = (low == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (low == 0xC9) & (after > 0x8F)
        odd = _any_in(dotted, offsets) | _any_in(_ODD[low] | signs, low_offsets)
        for s in self.special:
            odd |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        return odd

    def _split(self, lowered: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in lower-case pieces, by byte, and which word is the first of each piece: runs of letters or of others, single digits, and the seven contractions."""
        offsets, data = runtime.parts(lowered)
        kind = _KIND[data]
        new = np.empty(len(data), bool)
        if len(data):
            new[0] = True
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
        new[firsts] = True
        padded = np.concatenate([data, [0, 0, 0]])
        q = np.flatnonzero((data == 0x27) & new)
        if len(q):
            piece = np.searchsorted(offsets, q, "right") - 1
            room = offsets[piece + 1] - q
            one, two = padded[q + 1], padded[q + 2]
            short = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long_ = (room > 2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
            new[q[short | long_] + 1] = False
            for some, size in ((q[short], 2), (q[long_], 3)):
                new[some[some + size < len(data)] + size] = True
        if odd.any():  # one word each, which is not used
            inside = np.repeat(odd, np.diff(offsets))
            new &= ~inside
            new[offsets[:-1][odd & (offsets[1:] > offsets[:-1])]] = True
        starts = np.flatnonzero(new).astype(np.int32)
        return starts, np.searchsorted(starts, offsets)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces without white space: all ids, and where each piece's begin and how many it has."""
        lowered = pc.utf8_lower(pieces)
        odd = self._odd(pieces, lowered)
        starts, first = self._split(lowered, odd)
        _, data = runtime.parts(lowered)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        others: list[list[bytes | int]] = [self._odd_words(p) for p in pieces.filter(pa.array(odd)).to_pylist()]
        plain = np.ones(len(starts), bool)
        plain[first[:-1][odd & (first[1:] > first[:-1])]] = False
        # All words: those of plain pieces, then those of the others.
        of_others = [w if isinstance(w, bytes) else b"" for some in others for w in some]
        every = pa.concat_arrays([words.filter(pa.array(plain)), pa.array(of_others, pa.binary())]).dictionary_encode()
        tokens, sizes = self.automaton.walk(every.dictionary)
        word = every.indices.to_numpy()
        begin = np.cumsum(sizes) - sizes
        n = sizes[word]
        ids = self.ids[gather(tokens, begin[word], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        before = np.concatenate([[0], np.cumsum(plain)])[first]  # plain words before each piece
        low, high = before[:-1].copy(), before[1:].copy()
        sizes_of_others = np.array([len(x) for x in others], np.int64)
        stops = before[-1] + np.cumsum(sizes_of_others)
        low[odd], high[odd] = stops - sizes_of_others, stops
        where, count = ends[low], ends[high] - ends[low]
        added = [(k, w) for k, w in enumerate(w for some in others for w in some) if isinstance(w, int)]
        if added:  # added tokens have no words: put their ids between
            k = np.array([a for a, _ in added]) + before[-1]
            ids = np.insert(ids, ends[k], np.array([w for _, w in added], self.kind))
            extra = np.zeros(len(ends), np.int64)
            extra[k + 1] = 1
            ends += np.cumsum(extra)
            where, count = ends[low], ends[high] - ends[low]
        return ids, where, count

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the number of ids before each text and after the last.

        White space separates: no normalisation, split or merge reaches across it.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, where, count = self._pieces(coded.dictionary)
        piece = coded.indices.to_numpy()
        n = count[piece]
        ends = np.concatenate([[0], np.cumsum(n)])
        offsets = split.offsets.to_numpy()
        return gather(ids, where[piece], n), ends[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, some texts at a time: all ids, and the number before each text and after the last.

        A null text has none. A text of more than ``BLOCK_BYTES`` is encoded in parts that
        end at white space.
        """
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            if to == at + 1 and sizes[at] > BLOCK_BYTES:
                own = [self._block(pa.array([part], pa.string()))[0] for part in parts_of(texts[at].as_py(), BLOCK_BYTES)]
                ids = np.concatenate(own)
                yield ids, np.array([0, len(ids)])
            else:
                yield self._block(texts.slice(at, to - at))
            at = to

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The labels of the arcs of each text; without a decoder they are joined by blanks (unknown ids have none)."""
        used = ids <= self.most_id
        if not used.all():
            ends = np.concatenate([[0], np.cumsum(used)])[ends]
            ids = ids[used]
        labels = pc.take(self.shown, pa.array(ids))
        offsets = np.frombuffer(labels.buffers()[1], np.int64, len(labels) + 1)[ends]
        joined = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), labels.buffers()[2]])
        return pc.binary_slice(joined, 0, -1).cast(pa.large_string())


def parts_of(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end before white space."""
    space, at = re.compile(r"[\t\n\x0b\x0c\r ]"), 0
    while at < len(text):
        found = space.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The compiled tokenizer, once per worker."""
    return WordBpe(path)


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as 32-bit little-endian integers."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


SCHEMA = "doc_id bigint, ids binary, decoded string"


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns ``doc_id``, ``ids`` (32-bit little-endian integers) and ``decoded``, a row
    for each input row in no order. Null and empty texts have no ids and an empty
    decoding; repeated rows stay repeated; other columns of the input are ignored;
    an empty table gives an empty one. Narrow: no shuffle, and a worker holds the
    tables and one block of texts, nothing of the texts before it.
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            at, keys = 0, runtime.values(batch, "doc_id")
            for ids, ends in bpe.encode(runtime.values(batch, "text")):
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), packed(ids, ends), bpe.decode(ids, ends).cast(pa.string())], ["doc_id", "ids", "decoded"])
                at += n
        runtime.trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
