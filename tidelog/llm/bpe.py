"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its state after a token is that token's class of
allowed successors. It starts with every byte allowed after every byte, and each
merge (a, b) -> c, in order of rank, applies one gadget:

* the state behind `a` loses its arc for `b`;
* wherever an arc for `a` leaves a state, an arc for `c` now leaves it too;
* the state behind `c` is a copy of the one behind `b` before the gadget.

A word has exactly one path through the finished automaton, and it is the merge
encoding. The full table has vocabulary**2 arcs, so arcs are made on first use:
`allows` undoes the gadgets back from the youngest of the two tokens, and the
answer is kept as a transition of the table. Labels are read by a second table,
from prefix and byte to the next prefix. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: How the byte-level pre-tokenizer splits text (a fixed pattern of the public vocabulary).
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a space is not alone between two other characters.
_SPACES_MEET = re.compile(r"^ | $|\s | \s")
#: Encoded words, and runs of them, that a worker keeps.
KEPT = 300_000
#: Places in the table of arcs; a newer arc takes an older one's place.
ARCS = 1 << 21
_FREE, _SPREAD = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)
#: Words beyond this many bytes are encoded anew each time.
KEPT_BYTES = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: Latin-1 graphics stand for themselves, the rest for U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(31) | b.astype(np.uint64)


class Table:
    """Distinct uint64 keys below 2**63 and their int32 values, looked up many at a time; -1 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full((1 << self.bits) + 64, _FREE), np.full((1 << self.bits) + 64, -1, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values, at = keys[~got], values[~got], at[~got] + 1
            if len(at) and at.max() >= len(self.keys) - 1:  # the last place stays free
                self.keys, self.values = np.append(self.keys, np.full(64, _FREE)), np.append(self.values, np.full(64, -1, np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at, out, left = self._slots(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != _FREE)
            left, at = left[on], at[on] + 1
        return out


class Automaton:
    """merges: (left, right, merged) token ids in order of rank; labels: the bytes of each id."""

    def __init__(self, merges: list[tuple[int, int, int]], labels: dict[int, bytes], special: dict[str, int]):
        self.labels = [labels.get(i, b"") for i in range(max(labels, default=-1) + 1)]
        n = len(self.labels)
        self.sizes, self.packed = np.array([len(x) for x in self.labels], np.int64), [struct.pack("<I", i) for i in range(n)]
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        each = np.array(merges, np.int64).reshape(-1, 3)
        self.rank[each[:, 2]], self.left[each[:, 2]], self.right[each[:, 2]] = np.arange(len(each)), each[:, 0], each[:, 1]
        self.pair = Table(_pair(each[:, 0], each[:, 1]), np.arange(len(each), dtype=np.int32))
        self.merges = len(each)
        self.special = special
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.split = regex.compile(PRE_SPLIT).findall
        self.arcs = np.full(ARCS, _FREE)
        self.kept: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self._transitions({label: i for i, label in labels.items() if i not in special.values()})

    def _transitions(self, by_bytes: dict[bytes, int]) -> None:
        """The table that reads labels byte by byte: step[node << 8 | byte] is the next node, ends[node] the token that ends there.

        A token that no gadget makes arcs for has no place in it: its parts must have been allowed in a row at its rank.
        """
        made = np.flatnonzero(self.rank >= 0)
        reached = np.ones(len(self.labels), bool)
        reached[made] = self._allowed(self.left[made], self.right[made], self.rank[made])
        step, ends = {}, [-1]
        for label, token in by_bytes.items():
            node = 0
            for byte in label if reached[token] else b"":
                node = step.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            if node:
                ends[node] = token
        self.step, self.ends = Table(np.fromiter(step.keys(), np.uint64, len(step)), np.fromiter(step.values(), np.int32, len(step))), np.array(ends, np.int64)

    def _allowed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether an arc for b leaves the state behind a when only the gadgets of a rank below `until` have been applied."""
        a, b, until, rank = a.copy(), b.copy(), until.copy(), self.rank
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y, u = a[open_], b[open_], until[open_]
            at = self.pair[_pair(x, y)]
            on = (at < 0) | (at >= u)
            open_, x, y = open_[on], x[on], y[on]
            rx, ry = rank[x], rank[y]
            both = (rx < 0) & (ry < 0)
            out[open_[both]] = True
            copied = rx > ry  # the copy was made before the gadget took y's arc away; else the new arc came after
            until[open_], a[open_], b[open_] = np.where(copied, rx, ry + 1), np.where(copied, self.right[x], x), np.where(copied, y, self.left[y])
            open_ = open_[~both]
        return out

    def allows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether an arc for b leaves the state behind a, from the table of arcs; what it lacks is worked out and written into it."""
        key = _pair(a, b)
        at = ((key * _SPREAD) >> np.uint64(64 - (ARCS.bit_length() - 1))).astype(np.int64)
        entry = self.arcs[at]
        out = (entry & np.uint64(1)).astype(bool)
        new = np.flatnonzero(entry >> np.uint64(1) != key)
        if len(new):
            out[new] = said = self._allowed(a[new], b[new], np.full(len(new), self.merges))
            self.arcs[at[new]] = key[new] << np.uint64(1) | said
        return out

    def paths(self, words: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The ids of all words, and before which of them each word begins (one more for the end). All words go in step: the longest label whose arc leaves the state, and back where none does.

        Only one path leads to a position, so a position from which no way goes on is never entered again.
        """
        data = np.frombuffer(b"".join(words) + bytes(1), np.uint8).astype(np.uint64)
        stop = np.cumsum([len(w) for w in words])
        at = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        begin, dead = at.copy(), np.zeros(len(data) + 1, bool)
        # per position the token that ends before it, -1 at the start of a word
        last = np.full(len(data) + 1, -1, np.int64)
        live = np.flatnonzero(at < stop)
        state = np.full(len(words), -1, np.int64)
        while len(live):
            # read labels from the position of each word, as far as any goes
            node, place, who, ways = np.zeros(len(live), np.uint64), at[live], np.arange(len(live)), []
            while len(who):
                node = self.step[node << np.uint64(8) | data[place]]
                on = node >= 0
                node, place, who = node[on].astype(np.uint64), place[on] + 1, who[on]
                token = self.ends[node.astype(np.int64)]
                some = token >= 0
                ways.append((who[some], token[some]))
                on = place < stop[live[who]]
                node, place, who = node[on], place[on], who[on]
            took = np.full(len(live), -1, np.int64)
            for who, token in reversed(ways):
                on = took[who] < 0
                who, token = who[on], token[on]
                if not len(who):
                    continue
                before = state[live[who]]
                ok = ~dead[at[live[who]] + self.sizes[token]]
                ask = np.flatnonzero(ok & (before >= 0))
                ok[ask] = self.allows(before[ask], token[ask])
                took[who[ok]] = token[ok]
            moved, stuck = live[took >= 0], live[took < 0]
            at[moved] += self.sizes[took[took >= 0]]
            last[at[moved]] = state[moved] = took[took >= 0]
            dead[at[stuck]] = True
            at[stuck] -= self.sizes[state[stuck]]
            state[stuck] = np.where(at[stuck] > begin[stuck], last[at[stuck]], -1)
            live = live[at[live] < stop[live]]
            # a word's end has its last token in `state`, as the next word's marks may stand at the same place
        out_word, out_token, live = [], [], np.flatnonzero(at > begin)
        while len(live):
            out_word.append(live)
            out_token.append(state[live])
            at[live] -= self.sizes[state[live]]
            live = live[at[live] > begin[live]]
            state[live] = last[at[live]]
        if not out_word:
            return b"", np.zeros(len(words) + 1, np.int64)
        who, token = np.concatenate(out_word)[::-1], np.concatenate(out_token)[::-1]
        order = np.argsort(who, kind="stable")
        return token[order].astype("<u4").tobytes(), np.searchsorted(who[order], np.arange(len(words) + 1))

    def path(self, word: bytes) -> list[int]:
        """The tokens of one word."""
        return np.frombuffer(self.paths([word])[0], "<u4").tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; special tokens in the text are found first."""
        for held in (self.kept, self.chunks):
            if len(held) > KEPT:
                held.clear()
        # of each text: ids of special tokens, lists of words, and lists of runs between lone spaces
        plans, chunks, words = [], set(), set()
        for text in texts:
            plan = []
            for i, piece in enumerate(self.special_split.split(text) if self.special_split else [text]):
                if i % 2:
                    plan.append((self.packed[self.special[piece]], (), ()))
                elif piece and _SPACES_MEET.search(piece):
                    plan.append((b"", self.split(piece), ()))
                elif piece:
                    first, *rest = piece.split(" ")  # no split of the pre-tokenizer spans a lone space's left edge
                    plan.append((b"", self.split(first), rest))
                    chunks.update(rest)
                if plan:
                    words.update(plan[-1][1])
            plans.append(plan)
        words = list(words.difference(self.kept))
        self.kept.update(zip(words, self._cut(words, range(len(words) + 1))))
        chunks = list(chunks.difference(self.chunks))
        pieces = self.split(" " + " ".join(chunks)) if chunks else []
        self.chunks.update(zip(chunks, self._cut(pieces, [i for i, w in enumerate(pieces) if w[0] == " "] + [len(pieces)])))
        word, chunk = self.kept.__getitem__, self.chunks.__getitem__
        out = [b"".join([x for special, own, rest in plan for x in (special, *map(word, own), *map(chunk, rest))]) for plan in plans]
        for held, new in ((self.kept, words), (self.chunks, chunks)):
            for w in new:
                if len(w) > KEPT_BYTES:
                    del held[w]
        return out

    def _cut(self, words: list[str], at) -> list[bytes]:
        """The ids of words[at[0] : at[1]], words[at[1] : at[2]] and so on."""
        ids, ends = self.paths([w.encode() for w in words])
        ends = (4 * ends[np.asarray(at, np.int64)]).tolist()
        return [ids[x:y] for x, y in zip(ends, ends[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary in the tokenizers library's JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, vocab = byte_symbols(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = {i: bytes(symbols[c] for c in token) for token, i in vocab.items() if token not in special}
    labels |= {i: token.encode() for token, i in special.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Automaton([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], labels, special)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, with_tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, and with_tokens the ids and the decoded text.

    path: the vocabulary file, on every executor; None takes the public one that is installed. A null or empty text has no tokens. Repeated rows are encoded each.
    """

    def run(batches):
        automaton = load(path or vocabulary_path())
        for piece in common.slices(batches, "text"):
            ids = automaton.encode_all([t or "" for t in piece.column("text").to_pylist()])
            decoded = [automaton.decode(i) for i in ids]
            out = [piece.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                out += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(out, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_tokens
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public byte-level vocabulary and decoded again."""
    return encode_documents(common.read_table(spark, sf_dir, "documents"))
