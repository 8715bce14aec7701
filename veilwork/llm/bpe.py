"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It begins with one state from which every byte token leads back to that
state, and takes the merges in order. The gadget for merge (a, b) at time k looks at the state q that
arc a leads to: if q has an arc b, then q is copied without that arc, arc a is led to the copy, and
wherever arc a leaves, an arc ab is added that leads where b leads. After the last gadget only correct
tokenizations can be read, and as each beginning of a correct tokenization is one too, exactly one arc
ends at each byte of a word.

The driver compiles the automaton into tables of a fixed size once, and tasks get them by broadcast:

- the arcs' labels as a trie in two arrays (`base`, `check`), so a byte leads on by one addition;
- `target`, the state that each token's arc leads to;
- the arcs of states. A copy differs from its original by one arc, so copies of copies form a run, and
  the table has for (run, token) the time at which the run loses that arc. An arc added after a copy
  was made is there if that of its left part is, which `born` and `left` say.

Many words are read at once, byte by byte: from each place all labels that fit are followed, and the
one arc that the state there has for a label that ends at a place settles that place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import broadcast_parameter, free_name, once_per_worker, tidy

#: Parts of texts whose encoding a Python worker keeps twice at most, about 200 bytes each.
PARTS = 60_000
#: Longer parts of a text seldom come again and are not kept.
LONG_PART = 16
#: Characters of text that are encoded in one go; longer texts are cut before a single space between words.
SLICE = 1 << 19
#: Below so many words that go on, the rest of each is read on its own.
FEW = 24
#: Arcs whose presence a worker remembers, a power of two.
ARCS = 1 << 19
#: No merge has this time.
NEVER = 2**31 - 1

#: How byte-level vocabularies split text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points that the installed regex module, but not yet the tokenizers library, counts
#: as letters or numbers.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_SET = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
WORDS_NEWER = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER_SET}]]+| ?[\p{{N}}--[{NEWER_SET}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEWER_SET}])+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter for each byte in byte-level vocabulary files: itself if visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + n): b for n, b in enumerate(rest)}




#: The symbol behind each word: no label has it.
END = 256


#: Keys of arcs are state and token in one number.
MOST_TOKENS = 1 << 20


class Automaton:
    """The tokenization automaton of a byte-level BPE vocabulary, as it grows by the merges."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        top = max(vocab.values(), default=-1) + 1
        if top > MOST_TOKENS:
            raise ValueError(f"token ids must be below {MOST_TOKENS}: keys of arcs hold no more")
        self.born = [-1] * top  # time of the merge that makes a token
        self.left = [-1] * top
        # A state is (parent, missing, time); state 0 lacks no arc.
        self.parent, self.missing, self.time = [0], [-1], [-1]
        self.target = [0] * top  # where the arcs of a token lead
        self.live = {vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        for k, (x, y) in enumerate(merges):
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            if ab in self.live:
                raise ValueError(f"two merges make token {ab}")
            q, to = self.target[a], self.target[b]
            if a not in self.live or b not in self.live or not self._has(q, b):
                continue
            self.parent.append(q)
            self.missing.append(b)
            self.time.append(k)
            self.target[a], self.target[ab] = len(self.parent) - 1, to
            self.born[ab], self.left[ab] = k, a
            self.live.add(ab)

    def _has(self, state: int, token: int) -> bool:
        """Whether a state has an arc, from the states that it is a copy of."""
        parent, missing, time, born, left = self.parent, self.missing, self.time, self.born, self.left
        while state:
            k = time[state]
            while born[token] >= k:  # an arc added after the copy: as that of its left part
                token = left[token]
            if missing[state] == token:
                return False
            state = parent[state]
        return True

    def compiled(self) -> dict[str, np.ndarray]:
        """The automaton as tables."""
        n = len(self.parent)
        run, begun, tail, lost = [0] * n, [0], [0], {}
        for s in range(1, n):
            p = self.parent[s]
            if p and tail[run[p]] == p:
                run[s] = run[p]
            else:
                run[s] = len(begun)
                begun.append(p)
                tail.append(0)
            tail[run[s]] = s
            lost[run[s] << 20 | self.missing[s]] = self.time[s]
        labels = {t: i for t, i in self.vocab.items() if i in self.live}
        length = np.zeros(len(self.born), np.int32)
        for t, i in labels.items():
            length[i] = len(t)
        slots = 1 << max(8, (8 * len(lost)).bit_length())
        keys, times = np.full(slots, -1, np.int64), np.full(slots, NEVER, np.int32)
        left = np.array([*lost], np.int64)
        when, at = np.array([*lost.values()], np.int32), _slot(left, slots)
        while len(left):  # each key takes the first free slot from its own on
            _, first = np.unique(at, return_index=True)
            first = first[keys[at[first]] < 0]
            keys[at[first]], times[at[first]] = left[first], when[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, when, at = left[rest], when[rest], (at[rest] + 1) % slots
        ints = {"run": run, "time": self.time, "born": self.born, "left": self.left, "target": self.target, "run_begun": begun, "run_low": [self.time[s] for s in begun]}
        return {k: np.array(v, np.int32) for k, v in ints.items()} | {"length": length, "lost_key": keys, "lost_time": times} | _trie(labels)


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    """Where the search for a key begins in a table of so many slots, a power of two."""
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _trie(labels: dict[bytes, int]) -> dict[str, np.ndarray]:
    """The labels as a trie in arrays. Node x leads on by symbol c to node base[x] + c if check[base[x] + c] is x;
    `ends` has the token whose label ends at a node, or -1. Node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    token = [-1]
    for text, i in labels.items():
        node = 0
        for c in text:
            to = children[node].get(c)
            if to is None:
                to = children[node][c] = len(children)
                children.append({})
                token.append(-1)
            node = to
        token[node] = i
    size = 3 * len(children) + 4 * END
    used = np.zeros(size, bool)
    used[: END + 1] = True
    base, at = [END + 1] * len(children), [0] * len(children)
    # Nodes with many children first; those with one fill what is left. Places before `low` are taken or were tried.
    low = width = 0
    for node in sorted((x for x in range(len(children)) if children[x]), key=lambda x: -len(children[x])):
        own = np.array(sorted(children[node]), np.int64)
        if len(own) != width:
            low, width = END + 1, len(own)
        while True:
            free = low + np.flatnonzero(~used[low : low + 256])
            fits = free[~used[free[:, None] + (own - own[0])[None, :]].any(1)] if width > 1 else free
            if len(fits):
                break
            low += 256
        base[node] = int(fits[0] - own[0])
        low = int(fits[0])
        used[base[node] + own] = True
        for c, to in children[node].items():
            at[to] = base[node] + c
    out = {"base": np.zeros(size + END, np.int32), "check": np.full(size + END, -1, np.int32), "ends": np.full(size + END, -1, np.int32)}
    for node, below in enumerate(children):
        out["base"][at[node]], out["ends"][at[node]] = base[node], token[node]
        for to in below.values():
            out["check"][at[to]] = at[node]
    return out


class Reader:
    """Reads words with a compiled automaton."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables = tables
        self.single = {k: memoryview(v) for k, v in tables.items()}
        #: Arcs that were asked for of late, by the place of their key.
        self.asked, self.answer = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)

    def has(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether states have arcs for tokens."""
        key = state.astype(np.int64) << 20 | token
        at = _slot(key, ARCS)
        new = np.flatnonzero(self.asked[at] != key)
        out = self.answer[at]
        if len(new):
            out[new] = found = self._arcs(state[new], token[new])
            self.asked[at[new]], self.answer[at[new]] = key[new], found
        return out

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        t = self.tables
        out, going, until = np.ones(len(state), bool), np.flatnonzero(state), np.full(len(state), NEVER, np.int32)
        state, token, until = state[going], token[going], until[going]
        slots = len(t["lost_key"])
        while len(going):
            run = t["run"][state]
            key = run.astype(np.int64) << 20 | token
            at = _slot(key, slots)
            found = t["lost_key"][at]
            other = np.flatnonzero((found != key) & (found >= 0))
            while len(other):
                at[other] = (at[other] + 1) % slots
                found = t["lost_key"][at[other]]
                other = other[(found != key[other]) & (found >= 0)]
            when = t["lost_time"][at]
            lost = (t["lost_key"][at] == key) & (when <= t["time"][state]) & (when <= until)
            out[going[lost]] = False
            # An arc added after a copy: as that of its left part; else the run is settled, and what it began as decides.
            born = t["born"][token]
            later = born > t["run_low"][run]
            until, token = np.where(later, born, until), np.where(later, t["left"][token], token)
            state = np.where(later, state, t["run_begun"][run])
            on = ~lost & (state > 0)
            going, state, token, until = going[on], state[on], token[on], until[on]
        return out

    def _has(self, state: int, token: int) -> bool:
        return bool(self.has(np.array([state]), np.array([token]))[0])

    def _alone(self, symbols: np.ndarray, last: np.ndarray, at: int) -> None:
        """Settle the places of one word from `at` on."""
        base, check, ends, target = (self.single[k] for k in ("base", "check", "ends", "target"))
        word, settled, has = symbols.tolist(), last.tolist(), lru_cache(50_000)(self._has)
        for i in range(at, len(word) - 1):
            if i and settled[i] < 0:
                continue
            state, node, p = target[settled[i]] if i else 0, 0, i
            while check[to := base[node] + word[p]] == node:
                node, p = to, p + 1
                token = ends[node]
                if token >= 0 and has(state, token):
                    settled[p] = token
        last[:] = settled

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words one after another, and how many each word has."""
        t = self.tables
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        symbols = np.full(int(size.sum()) + len(words), END, np.int16)
        inside = np.ones(len(symbols), bool)
        inside[start + size] = False
        symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full(len(symbols), -1, np.int32)  # the token whose arc ends at a place
        order = np.argsort(-size, kind="stable")
        for j in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size[order], -j))
            if n < FEW:
                for w in order[:n].tolist():
                    own = slice(int(start[w]), int(start[w] + size[w]) + 1)
                    self._alone(symbols[own], last[own], j)
                break
            place = start[order[:n]] + j
            if j:
                place = place[last[place] >= 0]
            state = t["target"][last[place]] if j else np.zeros(n, np.int32)
            node, hits = np.zeros(len(place), np.int32), []
            while len(place):
                to = t["base"][node] + symbols[place]
                on = t["check"][to] == node
                node, place, state = to[on], place[on] + 1, state[on]
                token = t["ends"][node]
                hit = token >= 0
                hits.append((state[hit], token[hit], place[hit]))
            state, token, place = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (node, node, node)
            has = self.has(state, token)
            last[place[has]] = token[has]
        # The path, from its end.
        path = np.zeros(len(last), bool)
        at, begin = (start + size)[size > 0], start[size > 0]
        while len(at):
            if (last[at] < 0).any():
                raise ValueError("no path spells a word: the vocabulary lacks bytes")
            path[at] = True
            at = at - t["length"][last[at]]
            at, begin = at[at > begin], begin[at > begin]
        return last[path], np.add.reduceat(path, start) if len(words) else size


class Tokenizer:
    """A byte-level BPE tokenizer file: added tokens, word split, automaton, labels; made by the driver, used by tasks."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.tables = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs]).compiled()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        ordered = [labels.get(i, b"") for i in range(max(labels, default=-1) + 2)]  # the last one is empty
        self.label_ends, self.labels = np.cumsum([0, *map(len, ordered)]).astype(np.int32), b"".join(ordered)

    def n_bytes(self) -> int:
        return sum(v.nbytes for v in self.tables.values()) + self.label_ends.nbytes + len(self.labels)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about `size` characters. No word reaches over a single space between other characters."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


_CUT = regex.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Encodes texts with a Tokenizer, and remembers short parts of them."""

    def __init__(self, tokenizer: Tokenizer):
        self.reader, self.added = Reader(tokenizer.tables), tokenizer.added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words, self.words_newer = regex.compile(WORDS), regex.compile(WORDS_NEWER, regex.V1)
        self.newer = regex.compile(f"[{NEWER_SET}]")
        self.uneven = regex.compile(r"\s\s")
        #: What parts between single spaces encode to; they stand behind a space or begin with a line end. What of the
        #: last full memory is still used moves on.
        self.memory: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        """The token ids of each text as 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, str | bytes]] = []
        size = 0
        for row, text in enumerate(texts):
            out.append([])
            for part in self._parts(text or ""):
                waiting.append((row, part))
                size += len(part)
                if size >= SLICE:
                    self._settle(waiting, out)
                    waiting, size = [], 0
        self._settle(waiting, out)
        return [b"".join(x) for x in out]

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """Slices of the text, and the ids of added tokens."""
        if self.split_added is None or not any(t in text for t in self.added):
            yield from slices(text)
            return
        for n, x in enumerate(self.split_added.split(text)):
            if n % 2:
                yield np.int32(self.added[x]).tobytes()
            else:
                yield from slices(x)

    def _words(self, text: str) -> list[str]:
        return (self.words_newer if not text.isascii() and self.newer.search(text) else self.words).findall(text)

    def _settle(self, waiting: list[tuple[int, str | bytes]], out: list[list[bytes]]) -> None:
        """Encode parts of texts, each distinct word once."""
        split: list[tuple[list[str], list[str]]] = []
        for _, part in waiting:
            if isinstance(part, bytes):
                split.append(([], []))
            elif self.uneven.search(part):
                split.append((self._words(part), []))
            else:
                # Words never reach over single spaces and line ends.
                first, *rest = part.replace("\n", " \n").split(" ")
                split.append((self._words(first), rest))
        memory = self.memory
        new = {p for _, parts in split for p in parts}.difference(memory)
        again = new & self.before.keys()
        memory.update((p, self.before[p]) for p in again)
        new -= again
        # A part of letters is one word; the pattern splits others.
        plain = [p for p in new if p.isalpha() and (p.isascii() or max(p) < "\u0250")]
        words_of = {p: self._words(p if p[:1] == "\n" else " " + p) for p in new.difference(plain)}
        others = list({w for words, _ in split for w in words}.union(*words_of.values()))
        found = self._encoded([" " + p for p in plain] + others)
        memory.update(zip(plain, found, strict=False))
        of_word = dict(zip(others, found[len(plain) :], strict=True)).__getitem__
        memory.update((p, b"".join(map(of_word, words))) for p, words in words_of.items())
        of_part = memory.__getitem__
        for (row, part), (words, parts) in zip(waiting, split, strict=True):
            if isinstance(part, bytes):
                out[row].append(part)
            else:
                out[row] += [*map(of_word, words), b"".join(map(of_part, parts))]
        for p in [p for p in new if len(p) > LONG_PART]:
            del memory[p]
        if len(memory) > PARTS:
            self.before, self.memory = memory, {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        tokens, count = self.reader.read([w.encode() for w in words])
        data, ends = tokens.tobytes(), (4 * np.cumsum(count)).tolist()
        return [data[b:e] for b, e in zip([0, *ends], ends, strict=False)]


class Decoder:
    """Emits the labels of token ids."""

    def __init__(self, tokenizer: Tokenizer):
        n = len(tokenizer.label_ends) - 1
        self.labels = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(tokenizer.label_ends.tobytes()), pa.py_buffer(tokenizer.labels)]).cast(pa.large_binary())

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of sequences of ids, which end at `ends` (0 first). Ids without a label stand for nothing."""
        none = len(self.labels) - 1
        joined = self.labels.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].tobytes()), joined.buffers()[2] if len(ids) else pa.py_buffer(b"")])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are not UTF-8
            return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def _groups(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts in parts of about SLICE bytes, at least one row each."""
    ends = np.cumsum(pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _list_array(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    ids = np.frombuffer(b"".join(parts), np.int32)
    return ids, ends, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def _loaded(df: DataFrame, tokenizer: str | bytes) -> tuple[str, Broadcast]:
    """The compiled file, broadcast: the driver reads it, so executors need not have the path."""
    if isinstance(tokenizer, str):
        with open(tokenizer, "rb") as f:
            tokenizer = f.read()
    digest = hashlib.sha256(tokenizer).hexdigest()
    compiled = once_per_worker(("tokenizer", digest), lambda: Tokenizer(tokenizer))
    return digest, broadcast_parameter(df.sparkSession, compiled, compiled.n_bytes())


def _both(digest: str, shared: Broadcast) -> tuple[Encoder, Decoder]:
    return once_per_worker(("bpe", digest), lambda: (Encoder(shared.value), Decoder(shared.value)))


def encode(df: DataFrame, tokenizer: str | bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text column as array<int>.

    tokenizer: path or content of a byte-level BPE file of the tokenizers library. Nothing is added
    around a text; strings of added tokens in it become those tokens. Rows, repeated ones too, stay as
    they are, other columns are kept, and a column that is already called out is replaced. A null or
    empty text gives an empty array; an empty table gives an empty table. Texts are encoded whole.
    No shuffle: each task encodes its own Arrow batches.
    """
    digest, shared = _loaded(df, tokenizer)

    @F.arrow_udf("array<int>")
    @tidy
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, _ = _both(digest, shared)
        for batch in batches:
            for part in _groups(batch):
                yield _list_array(encoder(part.to_pylist()))[2]

    return df.withColumn(out, ids(F.col(f"`{text}`")))


def decode(df: DataFrame, tokenizer: str | bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of token ids stands for, added tokens included.

    Null gives null, an empty array the empty text; ids outside the vocabulary and null elements stand
    for nothing; bytes that do not form UTF-8 become U+FFFD. A column that is already called out is replaced.
    """
    digest, shared = _loaded(df, tokenizer)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, decoder = _both(digest, shared)
        for batch in batches:
            size = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = decoder(batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.cumsum([0, *size]))
            yield pa.array([x if v.is_valid else None for x, v in zip(found.to_pylist(), batch, strict=True)], pa.string()) if batch.null_count else found

    return df.withColumn(out, text(F.col(f"`{ids}`")))


def encode_and_decode(df: DataFrame, tokenizer: str | bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the token ids of a text column and the text that they decode to, in one pass over the texts.

    See encode and decode; a null text gives an empty array and an empty decoded text.
    """
    digest, shared = _loaded(df, tokenizer)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    @tidy
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _both(digest, shared)
        for batch in batches:
            for part in _groups(batch):
                flat, ends, lists = _list_array(encoder(part.to_pylist()))
                yield pa.StructArray.from_arrays([lists, decoder(flat, ends)], ["ids", "decoded"])

    own = free_name(df, "both")
    found = df.withColumn(own, both(F.col(f"`{text}`")))
    return found.withColumns({ids: F.col(f"{own}.ids"), decoded: F.col(f"{own}.decoded")}).drop(own)


def joined(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
