"""Token counts by a compiled byte transducer.

The byte-level BPE tokenizer is compiled, transition by transition as texts need them, into a deterministic transducer
over bytes. A state is what the rest of a text depends on: the open pre-token's kind and, for every suffix of it that
begins a vocabulary entry, the entry's trie node, the token before it and the token count up to it. A transition
carries the change of the number of tokens of the text read so far, so a state map is (exit state, added count).

Texts of any kind are cut every CHUNK bytes, at the next character. A chunk's state map holds the entry states that can
matter: the one that the bytes before the cut lead to, read from the last place where a white-space byte follows a
printable ASCII one (there all states act alike) or, without such a place, from LOOK_BACK bytes before. The maps of
adjacent chunks compose by a prefix scan: counts add where a chunk's entry is the exit of the one before. Where it is
another, the map gets that entry too, and its exit is handed on. The chunks of a batch run side by side in numpy, one
byte of each at a time.

Null texts count as empty. Empty texts have no tokens. Very long texts are many chunks. Repeated rows and ids are
separate rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps

#: Bytes of a chunk, and of what is read before one to find its entry state.
CHUNK, LOOK_BACK = 512, 64
#: States are forgotten beyond this number (about 100 MB of transitions); they are compiled again when needed.
MAX_STATES = 200_000
#: Second characters of the tokenizer pattern's contractions (fixed values).
ONE_LETTER, TWO_LETTERS = b"stmd", {b"r": b"e", b"v": b"e", b"l": b"l"}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: a printable Latin-1 byte stands for itself, the others for 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Which tokens may follow each other, and one byte's step of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.spelling = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t) and t.encode() not in self.special}
        self.single = {s[0]: i for i, s in self.spelling.items() if len(s) == 1}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for i, s in self.spelling.items():
            node = 0
            for b in s:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.inner[node] = True
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[at]
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """Plain BPE of a short byte string: the best-ranked pair is merged until none is left."""
        ids = [self.single[b] for b in text]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, before: int, token: int) -> bool:
        """Whether the pair is its own encoding; an encoding is right exactly if all its neighbours are."""
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = self.merged(self.spelling.get(before, b"") + self.spelling[token]) == [x for x in key if x >= 0]
        return self.pairs[key]

    def feed(self, state: tuple, text: bytes) -> tuple[tuple, int]:
        """The state after more bytes of the pre-token, and the change of its token count."""
        total = 0
        for b in text:
            opened, found = [], None
            for node, count, before in state:
                node = self.child.get(node << 8 | b)
                if node is not None:
                    if self.inner[node]:
                        opened.append((node, count, before))
                    token = self.token[node]
                    if token >= 0 and found is None and self.follows(before, token):
                        found = (count + 1, token)
            change, token = found
            total += change
            state = (*((n, c - change, p) for n, c, p in opened), (0, 0, token))
        return state, total


EMPTY = ((0, 0, -1),)
START, SEALED = ("start",), ("sealed",)


class Transducer:
    """Lazily compiled: table[state, column of the byte] is 0, not compiled, or the next state with the count's change, plus 256, in the low nine bits."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.kinds: dict[bytes, str] = {}
        self.column, self.byte = np.full(256, -1, dtype=np.int64), []
        self.width = 128
        self.clear()

    def clear(self) -> None:
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.zeros((MAX_STATES + 50_000) * self.width, dtype=np.int32)  # pages come with the first write
        self.intern((START, b""))
        self.intern((SEALED, b""))

    def intern(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        return self.ids[key]

    def kind(self, char: bytes) -> str:
        """The library's own pre-tokenizer says to which of its pattern's classes a character belongs."""
        if char not in self.kinds:
            alone = lambda before: len(self.bpe.library.pre_tokenizer.pre_tokenize_str(before + char.decode())) == 1
            self.kinds[char] = "letter" if alone("a") else "digit" if alone("1") else "other" if alone("!") else "space"
        return self.kinds[char]

    def begin(self, char: bytes) -> tuple[tuple, int]:
        state, n = self.bpe.feed(EMPTY, char)
        return ("quote" if char == b"'" else self.kind(char), state), n

    def on_char(self, key: tuple, char: bytes) -> tuple[tuple, int]:
        feed, kind = self.bpe.feed, self.kind(char)
        if kind == "space":
            # The run may end before its last character, so the state of the run without it is kept too.
            without = key[3] if key[0] == "space" else EMPTY
            state, n = feed(without, char)
            return ("space", without, n, state, char), n
        if key[0] == "space":
            _, _, last_n, _, last = key
            if last == b" ":
                state, n = feed(EMPTY, b" " + char)
                return (kind, state), n - last_n
            key, n = self.begin(char)
            return key, n - last_n + feed(EMPTY, last)[1]
        if key[0] == "quote":
            if len(char) == 1 and char in ONE_LETTER:
                return START, feed(EMPTY, b"'" + char)[1] - 1
            if char in TWO_LETTERS:
                return ("quoted", char, *self.begin(char)[0]), 1
            if kind == "other":
                state, n = feed(key[1], char)
                return (kind, state), n
        elif key[0] == "quoted":
            if char == TWO_LETTERS[key[1]]:
                return START, feed(EMPTY, b"'" + key[1] + char)[1] - 2
            if kind == "letter":
                state, n = feed(key[3], char)
                return (kind, state), n
        elif key[0] == kind:
            state, n = feed(key[1], char)
            return (kind, state), n
        return self.begin(char)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The texts' bytes as columns of the table, which has one for each byte met so far."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0)).tolist():
            self.column[b] = len(self.byte)
            self.byte.append(b)
        if len(self.byte) > self.width:
            self.width = 256
            self.clear()
        return self.column[data].astype(np.uint8)

    def compile(self, where: int) -> None:
        state, byte = divmod(where, self.width)
        byte = self.byte[byte]
        key, held = self.keys[state]
        held += bytes([byte])
        first = held[0]
        if len(held) < (1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4):
            to, n = self.intern((key, held)), 0
        else:
            key, n = self.on_char(key, held)
            to = self.intern((key, b""))
        self.table[where] = to << 9 | n + 256

    def run(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, entries: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
        """Each chunk's added count, from its entry state, and its exit state."""
        data = self.columns(data)
        order = np.argsort(-lengths, kind="stable")
        at, left, state = begins[order], lengths[order], np.array([self.intern(k) for k in entries], dtype=np.int64)[order]
        counts = np.zeros(len(order), dtype=np.int64)
        live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for j, n in enumerate(live.tolist()):
            where = state[:n] * self.width
            where += data[at[:n] + j]
            got = self.table[where]
            while n and not got.all():
                for w in np.unique(where[got == 0]).tolist():
                    self.compile(w)
                got = self.table[where]
            state[:n] = got >> 9
            counts[:n] += (got & 511) - 256
            if len(self.keys) > MAX_STATES:
                kept = [self.keys[s] for s in state.tolist()]
                self.clear()
                state = np.array([self.intern(k) for k in kept], dtype=np.int64)
        out, ends = np.empty_like(counts), [None] * len(order)
        out[order] = counts
        for i, s in zip(order.tolist(), state.tolist()):
            ends[i] = self.keys[s]
        return out, ends


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def character(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places, moved on to the next UTF-8 character's first byte."""
    for _ in range(3):
        at = at + ((data[at] & 0xC0) == 0x80)
    return at


class Chunks:
    """Texts that lie one after another, without the special tokens in them, cut into chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: list[bytes]):
        raw, self.n_special = data.tobytes(), np.zeros(len(offsets) - 1, dtype=np.int64)
        found = [(m.start(), m.end()) for m in re.finditer(b"|".join(map(re.escape, special)), raw)] if special else []
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        sealed = np.flatnonzero(blank[1:] & (data[:-1] >= 0x21) & (data[:-1] <= 0x7E)) + 1
        pieces, k = [], 0  # (text, begin, end)
        for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            while k < len(found) and found[k][0] < b:
                if found[k][0] >= a and found[k][1] <= b:
                    self.n_special[doc] += 1
                    pieces.append((doc, a, found[k][0]))
                    a = found[k][1]
                k += 1
            pieces.append((doc, a, b))
        docs, begins, ends, looks, known = [], [], [], [], []
        for doc, a, b in pieces:
            if b == a:
                continue
            cuts = character(data, np.arange(a + CHUNK, b - CHUNK, CHUNK))
            if len(cuts):
                back = character(data, np.maximum(cuts - LOOK_BACK, a))
                last = np.searchsorted(sealed, cuts, side="right") - 1
                at = np.where(last >= 0, sealed[last] if len(sealed) else -1, -1)
                is_sealed = at >= back
                looks += [a, *np.where(is_sealed, at, back).tolist()]
                known += [False, *is_sealed.tolist()]
            else:
                looks.append(a)
                known.append(False)
            docs += [doc] * (len(cuts) + 1)
            begins += [a, *cuts.tolist()]
            ends += [*cuts.tolist(), b]
        self.docs, self.begins, self.looks = (np.array(x, dtype=np.int64) for x in (docs, begins, looks))
        self.lengths = np.array(ends, dtype=np.int64) - self.begins
        #: Whether the look-back begins where all states act alike, and whether a chunk begins its piece.
        self.sealed = np.array(known, dtype=bool)
        self.first = np.ones(len(docs), dtype=bool)
        self.first[1:] = self.begins[1:] != self.begins[:-1] + self.lengths[:-1]
        self.first[1:] |= self.docs[1:] != self.docs[:-1]


def linked(maps: list[dict], entries: list[tuple], first: np.ndarray, begin: int) -> int | None:
    """Hands a chunk's exit on to the chunks after it while that changes their entries; the chunk whose map lacks its new entry, if there is one."""
    i = begin + 1
    while i < len(maps) and not first[i]:
        if entries[i - 1] not in maps[i - 1]:
            return None  # its new entry is still to be run; what follows is told then
        before = maps[i - 1][entries[i - 1]][0]
        if entries[i] == before:
            return None
        entries[i] = before
        if before not in maps[i]:
            return i
        i += 1
    return None


def count_batch(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cut = Chunks(data, offsets, machine.bpe.special)
    if not len(cut.docs):
        return cut.n_special
    later = np.flatnonzero(~cut.first)
    _, led = machine.run(data, cut.looks[later], cut.begins[later] - cut.looks[later], [(SEALED if s else START, b"") for s in cut.sealed[later].tolist()])
    entries = [(START, b"")] * len(cut.docs)
    for i, key in zip(later.tolist(), led):
        entries[i] = key
    #: Each chunk's state map: (exit state, added count) by entry state.
    maps: list[dict] = [{} for _ in entries]
    missed = list(range(len(entries)))
    while missed:
        added, exits = machine.run(data, cut.begins[missed], cut.lengths[missed], [entries[i] for i in missed])
        for i, n, key in zip(missed, added.tolist(), exits):
            maps[i][entries[i]] = (key, n)
        missed = sorted({i for i in (linked(maps, entries, cut.first, i) for i in missed) if i is not None})
    # All entries are the exits before them, so the maps compose by adding: an inclusive prefix scan, read at each text's last chunk.
    scan = np.concatenate([[0], np.cumsum([m[e][1] for m, e in zip(maps, entries)])])
    bounds = np.searchsorted(cut.docs, np.arange(len(offsets)), side="left")
    return scan[bounds[1:]] - scan[bounds[:-1]] + cut.n_special


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by the tokenizer in the file."""

    def count(batches):
        machine = transducer(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_utf8())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            n_tokens = [count_batch(machine, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in steps(np.diff(offsets).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *n_tokens]))], ["doc_id", "n_bytes", "n_tokens"])

    return id_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
