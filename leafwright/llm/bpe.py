"""BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

The vocabulary file is a ``tokenizers`` JSON of a BPE with word ends (``</w>``). A word is a sequence of
symbols; its last symbol is a different symbol from the same letter elsewhere, so that every vocabulary
entry is a plain sequence of symbols. At each position the encoder takes the longest vocabulary entry, and
keeps it only if it is *compatible* with the token before it, that is, if the merge rules leave exactly
these two tokens when they are applied to the two tokens' joined text. Otherwise it tries the next shorter
entry, and when none is left it gives up the token before. A position that once failed is marked and never
entered again, so the work is linear in the word's length. Compatible neighbours make the whole sequence
equal to what the merges give, hence results are exact.

Texts are encoded many at once: their distinct words go through the same steps in lockstep, as array operations
on the automaton's states, so nothing has to be remembered between batches but a table of pairs of fixed size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import map_batches, process_state, vocabulary_path

_WORD_END = "</w>"
#: Longer words (in bytes) are encoded one by one.
_LOCKSTEP = 64
#: Slots of the table of pairs, and of the automaton's transitions, as powers of two.
_PAIR_BITS, _EDGE_BITS = 20, 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: White space on which str.split() and the tokenizer's pattern may disagree, or that needs care.
_TRAILING = r"(\pL)([.,!%$#&*|;:?]+)(\s|$)"  # a run of punctuation between a letter and white space is a word of its own
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _WORD_END:
            raise ValueError("this encoder reads BPE vocabularies with word ends only")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self._byte_of = {c: b for b, c in enumerate(letters)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self._made: dict[int, tuple[int, int, int]] = {}  # the merge that makes an entry: its order, left and right
        by_name = self.vocab
        for order, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            joined = by_name.get(left + right)
            if joined is not None:
                self.rank[by_name[left], by_name[right]] = (order, joined)
                self._made.setdefault(joined, (order, by_name[left], by_name[right]))
        # Symbols 0..255 are bytes inside a word, 256..511 bytes that end one; as letters for the automaton.
        self.symbol = [by_name[c] for c in letters] + [by_name[c + _WORD_END] for c in letters]
        self.spelling: dict[int, str] = {}
        for name, ident in by_name.items():
            ends = name.endswith(_WORD_END) and len(name) > len(_WORD_END)
            body = name[: -len(_WORD_END)] if ends else name
            if body and all(c in self._byte_of for c in body):
                symbols = [self._byte_of[c] for c in body]
                symbols[-1] += 256 if ends else 0
                self.spelling[ident] = "".join(map(chr, symbols))
        self._tables()
        # Entries that the merges never make from their own text can't occur in an encoding.
        reachable = {i for i, s in self.spelling.items() if self._merge([self.symbol[ord(c)] for c in s]) == [i]}
        self._automaton = ahocorasick.Automaton()
        for ident in reachable:
            self._automaton.add_word(self.spelling[ident], ident)
        self._automaton.make_automaton()
        # The number of symbols of each entry, and the longest other entry that it starts with (-1: none).
        self._symbols = {i: len(self.spelling[i]) for i in reachable}
        by_text = {self.spelling[i]: i for i in reachable}
        self._shorter = {i: next((by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_text), -1) for s, i in by_text.items()}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._states(by_text)
        # Offset table for decoding: entry i is blob[offset[i]:offset[i + 1]].
        names = {i: n for n, i in [*by_name.items(), *self.special.items()]}
        self.size = max(names) + 1
        entries = [names.get(i, "").encode() for i in range(self.size)]
        self._blob = np.frombuffer(b"".join(e + b" " for e in entries), np.uint8)
        self._length = np.array([len(e) + 1 for e in entries], np.int64)
        self._offset = np.concatenate([[0], np.cumsum(self._length)[:-1]])

    def _merge(self, tokens: list[int]) -> list[int]:
        """The merge rules applied in order of rank, for short sequences only (tokens and pairs of tokens)."""
        tokens = list(tokens)
        while len(tokens) > 1:
            best = min(((self.rank[p][0], k) for k in range(len(tokens) - 1) if (p := (tokens[k], tokens[k + 1])) in self.rank), default=None)
            if best is None:
                break
            pair = tokens[best[1]], tokens[best[1] + 1]
            out, k = [], 0
            while k < len(tokens):
                if k + 1 < len(tokens) and (tokens[k], tokens[k + 1]) == pair:
                    out.append(self.rank[pair][1])
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        return tokens

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side; a table filled on demand."""
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            known = self._stays(left, right)
            if len(self._compatible) >= 100_000:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, the latest first: no pair across the border may have merged before."""
        made, rank, limit = self._made, self.rank, float("inf")
        while True:
            across = rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            mine, other = made.get(left), made.get(right)
            if mine and (not other or mine[0] > other[0]):
                limit, left = mine[0], mine[2]
            elif other:  # of equal merges the left one comes first, so a pair across wins against the right one
                limit, right = other[0] + 1, other[1]
            else:
                return True

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        known, compatible, length, shorter = self._compatible.get, self.compatible, self._symbols, self._shorter
        greedy = [ident for _, ident in self._automaton.iter_long(text)]  # the longest match at each step, never given up
        for k, pair in enumerate(zip(greedy, greedy[1:])):
            if not (known(pair) or compatible(*pair)):
                break
        else:
            return greedy
        path, n, dead = greedy[: k + 1], len(text), set()
        at, token = sum(map(length.__getitem__, path)), shorter[greedy[k + 1]]
        while True:
            before = path[-1] if path else -1
            while token >= 0 and (at + length[token] in dead or before >= 0 and not (known((before, token)) or compatible(before, token))):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                if at == n:
                    return path
                token = next(self._automaton.iter_long(text, at))[1]
            elif path:
                dead.add(at)
                token = path.pop()
                at -= length[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _word(self, word: str) -> bytes:
        return array("I", self.encode_word(word.encode("utf-8"))).tobytes()

    def _tables(self) -> None:
        """The merge rules as sorted pairs, and for each entry the order, left and right of the merge that makes it."""
        pairs = sorted((left << 32 | right, order) for (left, right), (order, _) in self.rank.items())
        self._pair_key = np.array([k for k, _ in pairs], np.int64)
        self._pair_order = np.array([o for _, o in pairs], np.int64)
        self._origin = np.full((max(self.vocab.values()) + 1, 3), -1, np.int64)
        for ident, made in self._made.items():
            self._origin[ident] = made
        self._known = np.full(1 << _PAIR_BITS, -1, np.int64)  # a pair in each slot, and what is known of it
        self._fits = np.zeros(1 << _PAIR_BITS, bool)

    def _states(self, by_text: dict[str, int]) -> None:
        """The automaton's states as arrays: transitions by (state, symbol) in a hash table, the entry that ends in each."""
        edges: dict[int, int] = {}
        ends = [-1]
        for text, ident in by_text.items():
            state = 0
            for c in text:
                key = state << 9 | ord(c)
                state = edges.get(key, 0)
                if not state:
                    state = edges[key] = len(ends)
                    ends.append(-1)
            ends[state] = ident
        self._ends = np.array(ends, np.int64)
        self._first = np.zeros(512, np.int64)
        keys, to = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        self._first[keys[keys < 512]] = to[keys < 512]
        self._edge, self._to = np.full(1 << _EDGE_BITS, -1, np.int64), np.zeros(1 << _EDGE_BITS, np.int64)
        slot = self._slot(keys, _EDGE_BITS)
        while len(keys):  # linear probing: of those that want a free slot the first one gets it
            free = np.flatnonzero(self._edge[slot] < 0)
            mine = free[np.unique(slot[free], return_index=True)[1]]
            self._edge[slot[mine]], self._to[slot[mine]] = keys[mine], to[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & ((1 << _EDGE_BITS) - 1)
        size = len(self._origin)
        self._sizes, self._next = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        for ident, n in self._symbols.items():
            self._sizes[ident], self._next[ident] = n, self._shorter[ident]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).view(np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol; 0 where the automaton has no transition."""
        key = state << 9 | symbol
        slot = self._slot(key, _EDGE_BITS)
        found = self._edge[slot]
        out = np.where(found == key, self._to[slot], 0)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _EDGE_BITS) - 1)
            found = self._edge[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self._to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def _longest(self, symbols: np.ndarray) -> np.ndarray:
        """The longest entry that starts at each symbol; none crosses a word's end, as its last symbol ends entries."""
        state = self._first[symbols]
        best, at = self._ends[state], np.arange(len(symbols))
        depth = 1
        while True:
            keep = (state > 0) & (at + depth < len(symbols))
            at, state = at[keep], state[keep]
            if not len(at):
                return best
            state = self._step(state, symbols[at + depth])
            found = self._ends[state]
            best[at[found >= 0]] = found[found >= 0]
            depth += 1

    def _compatible_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs; the table keeps the latest pair of each slot."""
        key = left << 32 | right
        slot = self._slot(key, _PAIR_BITS)
        out = self._fits[slot]
        new = np.flatnonzero(self._known[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            fits = self._all_stay(asked >> 32, asked & 0xFFFFFFFF)
            out[new] = fits[back]
            at = self._slot(asked, _PAIR_BITS)
            at, first = np.unique(at, return_index=True)
            self._known[at], self._fits[at] = asked[first], fits[first]
        return out

    def _all_stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_stays`` for many pairs at once."""
        out = np.ones(len(left), bool)
        at, left, right, limit = np.arange(len(left)), left.copy(), right.copy(), np.full(len(left), 1 << 40)
        while len(at):
            key = left << 32 | right
            found = np.minimum(np.searchsorted(self._pair_key, key), len(self._pair_key) - 1)
            merges = (self._pair_key[found] == key) & (self._pair_order[found] < limit)
            out[at[merges]] = False
            mine, other = self._origin[left], self._origin[right]
            by_left = mine[:, 0] > other[:, 0]
            go = ~merges & (by_left | (other[:, 0] >= 0))
            limit = np.where(by_left, mine[:, 0], other[:, 0] + 1)[go]
            left, right, at = np.where(by_left, mine[:, 2], left)[go], np.where(by_left, right, other[:, 1])[go], at[go]
        return out

    def encode_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (bytes ``data[bounds[k]:bounds[k + 1]]``, none empty) one after another, and how many each has."""
        symbols = data.astype(np.int64)
        end = bounds[1:].astype(np.int64)
        symbols[end - 1] += 256
        longest = self._longest(symbols)
        start = bounds[:-1].astype(np.int64)
        path, dead = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols) + 1, bool)
        depth = np.zeros(len(start), np.int64)
        # Of the words under way: their number, place, the token before, and the one that is tried next.
        word, at, before, token = np.arange(len(start)), start.copy(), np.full(len(start), -1, np.int64), longest[start]
        while len(word):
            tried = token >= 0
            fits = tried & ~dead[at + self._sizes[np.maximum(token, 0)] * tried]
            pair = np.flatnonzero(fits & (before >= 0))
            fits[pair] = self._compatible_pairs(before[pair], token[pair])
            # Those that fit are taken; after the others the next shorter entry is tried, or the token before is given up.
            back = np.flatnonzero(~tried)
            if len(back):
                if (depth[word[back]] == 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                dead[at[back]] = True
                depth[word[back]] -= 1
                given = before[back]
                at[back] -= self._sizes[given]
                held = depth[word[back]]
                before[back] = np.where(held > 0, path[start[word[back]] + held - 1], -1)
                token[back] = given
            rest = ~fits
            token[rest] = self._next[token[rest]]
            took = np.flatnonzero(fits)
            path[start[word[took]] + depth[word[took]]] = token[took]
            depth[word[took]] += 1
            at[took] += self._sizes[token[took]]
            before[took] = token[took]
            done = np.zeros(len(word), bool)
            done[took] = at[took] == end[word[took]]
            on = took[~done[took]]
            token[on] = longest[at[on]]
            if done.any():
                keep = ~done
                word, at, before, token = word[keep], at[keep], before[keep], token[keep]
        index = np.repeat(start - (np.cumsum(depth) - depth), depth)
        index += np.arange(len(index))
        return path[index].astype("<u4"), depth

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs without white space, and how many each has; no word crosses white space, so runs are independent."""
        chunks = pa.concat_arrays([chunks])  # its own offsets, from 0
        size = pc.binary_length(chunks).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        # Runs of letters of the older alphabets are words; others are asked for one by one.
        plain = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False) & (size <= _LOCKSTEP)
        late = np.concatenate([[0], np.cumsum(data >= 0xE0)])
        plain &= late[bounds[1:]] == late[bounds[:-1]]
        length = np.zeros(len(chunks), np.int64)
        words = np.flatnonzero(plain)
        index = np.repeat(bounds[words] - (np.cumsum(size[words]) - size[words]), size[words])
        index += np.arange(len(index))
        ids, length[words] = self.encode_words(data[index], np.concatenate([[0], np.cumsum(size[words])]))
        others = np.flatnonzero(~plain)
        spelled = [b"".join(map(self._word, self.pattern.findall(c))) for c in chunks.take(pa.array(others)).to_pylist()]
        length[others] = [len(x) // 4 for x in spelled]
        out = np.zeros(int(length.sum()), "<u4")
        mine = np.repeat(plain, length)
        out[mine] = ids
        out[~mine] = np.frombuffer(b"".join(spelled), "<u4")
        return out, length

    @staticmethod
    def _normal(text: str) -> str:
        """NFC and lower case, letter by letter: no rule for a final sigma."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pattern.findall(regex.sub(r"\s+", " ", self._normal(text)))))

    def _odd(self, text: str) -> bool:
        return (self._special is not None and "<|" in text and self._special.search(text) is not None) or any(c in text for c in _ODD_SPACE)

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        if self._special is None:
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def encode_all(self, texts: list[str | None], piece: int = 1 << 23) -> list[np.ndarray]:
        """Ids of each text (null: none). Runs without white space are looked up once for many texts together."""
        out: list[np.ndarray] = []
        some, held = [], 0
        for text in texts:
            some.append(text or "")
            held += len(some[-1])
            if held >= piece:
                out += self._encode_some(some)
                some, held = [], 0
        return out + self._encode_some(some)

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if self._odd(t)}
        rows = pa.array(["" if k in odd else self._normal(t) for k, t in enumerate(texts)], pa.string())
        runs = pc.utf8_split_whitespace(pc.replace_substring_regex(rows, _TRAILING, r"\1 \2\3"))
        coded = runs.flatten().dictionary_encode()
        ids, length = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy()
        n = length[which]
        end = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(end[-1], len(ids)) < 1 << 31 else np.int64
        index = np.repeat(((np.cumsum(length) - length)[which] - end[:-1]).astype(kind), n)
        index += np.arange(len(index), dtype=kind)
        ids, bound = ids[index], end[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        return [self.encode_text(t) if k in odd else ids[bound[k] : bound[k + 1]] for k, t in enumerate(texts)]

    def decode_bytes(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        """The entries' texts with a space between them, as the library joins them when a file has no decoder."""
        out = []
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            length = self._length[part]
            ends = np.cumsum(length)
            index = np.repeat(self._offset[part] - (ends - length), length)
            index += np.arange(len(index))
            out.append(self._blob[index].tobytes())
        return b"".join(out)[:-1]


def encoder(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    state = process_state(__name__)
    if path not in state:
        state[path] = WordBpe(path)
    return state[path]


class _Digests:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch) -> dict:
        bpe = encoder(self.path)
        count, ids_sha, text_sha = [], [], []
        for ids in bpe.encode_all(batch.column(1).to_pylist()):
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": count, "ids_sha256": ids_sha, "decoded_sha256": text_sha}


class _Ids:
    def __init__(self, path: str, decode: bool):
        self.path, self.with_text = path, decode

    def __call__(self, batch) -> dict:
        bpe = encoder(self.path)
        ids = bpe.encode_all(batch.column(1).to_pylist())
        text = [bpe.decode_bytes(x).decode("utf-8", "replace") if self.with_text else None for x in ids]
        return {"doc_id": batch.column(0), "ids": ids, "decoded": text}


def encode_column(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and, if asked, ``decoded`` for every row of ``doc_id, text``.

    A null text counts as empty and gives no ids. Repeated rows give repeated rows; other columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_batches(_input(docs), _Ids(path or vocabulary_path(), decode), schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``documents`` with digests of the whole text's ids and of their decoding.

    Null and empty texts: no tokens, digests of nothing. Texts of any length are encoded whole. Repeated rows
    stay repeated; an empty table gives an empty result; further columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_batches(_input(docs), _Digests(path or vocabulary_path()), schema)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
