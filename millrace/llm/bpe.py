"""BPE encoding and decoding with a minimal acyclic transducer as lexicon of frequent words.

The words that make up at least ``min_share`` of all words of the corpus (so at most 1 / min_share
words, whatever its size) are encoded once and compiled into a minimal acyclic automaton whose
transitions carry outputs; their sum along a word is its rank, which indexes its token ids. The
automaton and the ids are one file of fixed-width tables that every worker maps into memory, so the
workers of a machine share its pages. Words outside of the lexicon are merged exactly, pair by pair in
rank order, and kept in a bounded cache.

Defined cases: a null text is the empty text and has no ids; special tokens' strings in a text become
their ids, as the tokenizers library does by default; repeated rows give repeated results; other columns
of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import Workspace, batch_rows, put_bytes

#: Share of all words from which a word goes into the lexicon.
MIN_SHARE = 3e-6
#: Entries of a worker's cache of words outside the lexicon, and of its counts before they are passed on.
CACHE = 400_000
#: Bytes of a word from which merges wait in a heap.
LONG = 100
# White space of Unicode, and the contractions that the pre-tokenizer keeps together.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
END = "</w>"


def byte_letters() -> dict[str, int]:
    """The byte for each letter that byte-level vocabularies write for it: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and ids of a BPE tokenizer file with word ends, over raw bytes."""

    def __init__(self, text: str):
        d = json.loads(text)
        model, letters = d["model"], byte_letters()
        vocab = model["vocab"]
        self.first = [0] * 256
        self.last = [0] * 256
        for letter, byte in letters.items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + END]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.text = {i: t.encode() for t, i in (vocab | self.special).items()}
        self.find_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the leftmost pair of the least rank becomes one symbol."""
        if len(word) > LONG:
            return self._merge_long(word)
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        merges, none = self.merges, (1 << 60, 0)
        ranks = [merges.get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = merges.get(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = merges.get(ids[at] << 32 | ids[at + 1], none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for long words: pairs wait in a heap by rank and place, symbols are a doubly linked list, so n log n in all."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                found = merges.get(ids[x] << 32 | ids[y]) if x >= 0 and y < n else None
                if found:
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y], found[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the tokens' strings with spaces between, as a tokenizer without a decoder gives; unknown ids are skipped."""
        text = self.text
        return b" ".join([text[i] for i in ids if i in text])


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 other."""
    if not _CLASSES:
        kind = {"L": 1, "N": 2}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)), np.uint8, 0x110000)
        table[[ord(c) for c in SPACES]] = 0
        _CLASSES.append(table)
    return _CLASSES[0]


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Words:
    """Words of several texts: their bytes one after the other, and where each begins and ends."""

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = classes()[cp]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        start = (kind != 0) & ((kind != before) | (kind == 2))
        for i in np.flatnonzero(start[:-1] & start[1:] & (cp[:-1] == 39)):  # an apostrophe by itself, something right after it
            for tail in CONTRACTIONS:
                if whole.startswith(tail, i + 1):
                    start[i + 1] = False
                    if kind[i + 1 + len(tail)] == 1:
                        start[i + 1 + len(tail)] = True
                    break
        at = np.flatnonzero(start)
        stop = np.flatnonzero(start | ((kind == 0) & (before != 0)))
        end = stop[np.searchsorted(stop, at, "right")] if len(at) else at
        self.data = np.frombuffer(whole.encode(), np.uint8)
        if len(self.data) == len(cp):
            self.start, self.end = at, end
        else:
            place = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), out=place[1:])
            self.start, self.end = place[at], place[end]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))  # of each text's words

    def slices(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def minimal_transducer(words: list[bytes]) -> tuple[np.ndarray, list[tuple[list[int], list[int], list[int]]], np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words: byte classes, of each state its transitions (classes, next states, outputs), final states.

    State 0 is dead, 1 the start. The outputs along a word add up to its rank among the words. Built
    from sorted words with a register of states by their outgoing transitions, so that states with the
    same future are one.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # open states along the last word: final, closed transitions

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    last = b""
    for word in [*words, b""]:
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            child = close(path.pop())
            path[-1][1].append((last[depth - 1], child))
        for _ in word[common:]:
            path.append([False, []])
        if word:
            path[-1][0] = True
        last = word
    root = close(path[0])
    n = len(states)
    number = np.full(n, 0, np.int64)
    number[root] = 1
    others = [s for s in range(n) if s != root]
    number[others] = np.arange(2, n + 1)
    used = sorted({b for _, moves in states for b, _ in moves})
    klass = np.full(256, len(used), np.int64)
    klass[used] = np.arange(len(used))
    final, below = np.zeros(n + 1, np.int32), [0] * n
    moves_of: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(n + 1)]
    for s, (ends, moves) in enumerate(states):  # children come before their parents
        total, (bytes_, to, out) = int(ends), moves_of[number[s]]
        for b, child in moves:
            bytes_.append(int(klass[b])), to.append(int(number[child])), out.append(total)
            total += below[child]
        below[s], final[number[s]] = total, ends
    return klass, moves_of, final


def packed(moves_of: list[tuple[list[int], list[int], list[int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transitions in one row of cells: a state's base, and of each cell its owner, next state and output.

    The transition of a class is in the cell at base + class, if the state owns it. States with several transitions take the first base
    where all their cells are free; those with one, which are most, fill the gaps. So there is about a cell a transition.
    """
    several = sorted((s for s, m in enumerate(moves_of) if len(m[0]) > 1), key=lambda s: -len(moves_of[s][0]))
    size = sum(len(m[0]) for m in moves_of) + 2 * width
    taken, base, low = np.zeros(2 * size + 8192, bool), np.zeros(len(moves_of), np.int64), 0
    for s in several:
        at = np.array(moves_of[s][0])
        start = low
        while True:
            if start + 4096 + width > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            bad = taken[start + at[0] : start + at[0] + 4096].copy()
            for k in at[1:]:
                bad |= taken[start + k : start + k + 4096]
            if not bad.all():
                break
            start += 4096
        base[s] = start + int(np.argmin(bad))
        taken[base[s] + at] = True
        while taken[low : low + 4096].sum() > 3900:  # nearly full
            low += 4096
    one = [s for s, m in enumerate(moves_of) if len(m[0]) == 1]
    if one:
        first = np.array([moves_of[s][0][0] for s in one])
        taken = np.concatenate([taken, np.zeros(len(one), bool)])
        free = np.flatnonzero(~taken[width:])[: len(one)] + width
        base[one] = free - first
        taken[free] = True
    cells = int(np.flatnonzero(taken)[-1]) + 1 + width if taken.any() else width
    owner, to, out = np.full(cells, -1, np.int32), np.zeros(cells, np.int32), np.zeros(cells, np.int32)
    for s, (at, nxt, add) in enumerate(moves_of):
        if at:
            i = base[s] + np.array(at)
            owner[i], to[i], out[i] = s, nxt, add
    return base.astype(np.int32), owner, to, out


class Lexicon:
    """The transducer and the ids of its words, in one file of int32 that is mapped into memory."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int32, "r")
        states, cells, words, ids = flat[:4].tolist()
        parts = np.cumsum([4, 256, states, states, cells, cells, cells, words + 1, ids])
        self.klass, self.base, self.final, self.owner, self.next, self.out, self.offset, self.ids = (flat[a:b] for a, b in zip(parts[:-1], parts[1:], strict=True))

    @staticmethod
    def compile(words: list[bytes], vocab: Vocabulary) -> bytes:
        words = sorted(set(words))
        klass, moves_of, final = minimal_transducer(words)
        base, owner, to, out = packed(moves_of, int(klass.max()) + 1)
        each = [vocab.merge(w) for w in words]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        ids = np.array([i for x in each for i in x], np.int32)
        head = np.array([len(base), len(owner), len(words), len(ids)], np.int32)
        return b"".join(np.ascontiguousarray(part, np.int32).tobytes() for part in (head, klass, base, final, owner, to, out, offset, ids))

    def ranks(self, words: Words) -> np.ndarray:
        """Rank of each word, -1 for words that aren't in the lexicon; all words walk the automaton at once."""
        n = len(words.start)
        result = np.full(n, -1, np.int64)
        live, at, stop = np.arange(n), words.start.copy(), words.end.copy()
        state, total, klass = np.ones(n, np.int64), np.zeros(n, np.int64), self.klass[words.data]
        while len(live):
            cell = self.base[state] + klass[at]
            own = self.owner[cell] == state
            if not own.all():
                live, at, stop, state, total, cell = live[own], at[own], stop[own], state[own], total[own], cell[own]
            total = total + self.out[cell]
            state = self.next[cell]
            at = at + 1
            done = at == stop
            if done.any():
                hit = done & (self.final[state] > 0)
                result[live[hit]] = total[hit]
                live, at, stop, state, total = live[~done], at[~done], stop[~done], state[~done], total[~done]
        return result


class Encoder:
    """Encodes batches of texts with a vocabulary and a lexicon (or none)."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon, self.cache = vocab, lexicon, {}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        words = Words([normal(t) for t in texts])
        n = len(words.start)
        known = self.lexicon.ranks(words) if self.lexicon else np.full(n, -1, np.int64)
        rest = np.flatnonzero(known < 0)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, merge, own, place = self.cache, self.vocab.merge, [], {}
        spots = np.empty((len(rest), 2), np.int64)
        for k, w in enumerate(words.slices(rest)):
            spot = place.get(w)
            if spot is None:
                ids = cache.get(w)
                if ids is None:
                    ids = cache[w] = merge(w)
                spot = place[w] = (len(own), len(ids))
                own += ids
            spots[k] = spot
        lex = self.lexicon.ids if self.lexicon else np.zeros(0, np.int32)
        flat = np.concatenate([lex, np.array(own, np.int32)])
        start, size = np.empty(n, np.int64), np.empty(n, np.int64)
        inside = np.flatnonzero(known >= 0)
        if len(inside):
            offset = self.lexicon.offset
            start[inside] = offset[known[inside]]
            size[inside] = offset[known[inside] + 1] - start[inside]
        start[rest], size[rest] = spots[:, 0] + len(lex), spots[:, 1]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])].astype("<u4")
        cut = total[words.bounds]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        find, pieces, plan = self.vocab.find_special, [], []
        for t in texts:
            t = t or ""
            if find is None or "<" not in t or not find.search(t):
                plan.append(len(pieces))
                pieces.append(t)
                continue
            own: list = []
            at = 0
            for m in find.finditer(t):
                own += [len(pieces), np.array([self.vocab.special[m[0]]], "<u4")]
                pieces.append(t[at : m.start()])
                at = m.end()
            own.append(len(pieces))
            pieces.append(t[at:])
            plan.append(own)
        done = self._plain(pieces) if pieces else []
        return [done[p] if isinstance(p, int) else np.concatenate([done[x] if isinstance(x, int) else x for x in p]) for p in plan]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts: counted in each task, then summed by word."""
    batch_rows(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            words = Words([normal(t or "") for t in b.column(0).to_pylist()])
            counts.update(words.slices(np.arange(len(words.start))))
            if len(counts) > CACHE:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, min_share: float = MIN_SHARE) -> str:
    """Compiles the frequent words of the texts; returns the name under which SparkFiles has the lexicon on every node."""
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark)
    counts = ws.save(count_words(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = [bytes(r[0]) for r in counts.where(F.col("n") >= max(1, min_share * total)).select("word").collect()]  # at most 1 / min_share words
    ws.drop()
    name = f"lexicon-{hashlib.sha256(b' '.join(sorted(frequent))).hexdigest()[:16]}-{os.urandom(4).hex()}.bin"
    uri = Workspace(spark).path(name)  # stays for executors that come later, until the session's end
    put_bytes(spark, uri, Lexicon.compile(frequent, Vocabulary(vocabulary)))
    spark.sparkContext.addFile(uri)  # Spark copies it to each node that runs tasks
    return name


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str, lexicon: str) -> Encoder:
    """One encoder for each lexicon in a worker."""
    if lexicon not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[lexicon] = Encoder(Vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)))
    return _ENCODERS[lexicon]


def encode(docs: DataFrame, vocabulary_path: str, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id and ids (array of int) of each whole text."""
    return _apply(docs, vocabulary_path, min_share, "doc_id long, ids array<int>", lambda v, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))])


def digest(docs: DataFrame, vocabulary_path: str, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""

    def columns(vocab: Vocabulary, ids: list[np.ndarray]) -> list[pa.Array]:
        text = vocab.text
        decoded = (b" ".join([text[i] for i in x.tolist()]) for x in ids)
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]

    return _apply(docs, vocabulary_path, min_share, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _apply(docs: DataFrame, vocabulary_path: str, min_share: float, schema: str, columns) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    lexicon = build_lexicon(docs, text, min_share)
    sent = docs.sparkSession.sparkContext.broadcast(text)  # the tokenizer's file, of a fixed size
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(enc.vocab, enc.encode(b.column(1).to_pylist()))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids are no ids."""
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vocab.decode(x or []).decode() for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
