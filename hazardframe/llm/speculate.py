"""Byte-pair encoding by speculation, and decoding.

A word (a unit of the tokenizer's own splitting) is first cut by greedy longest match in the vocabulary. The cut is the
true one exactly if no merge would ever cross one of its seams, and whether one does depends on the two tokens at the
seam alone: while the words merge, the symbols next to the seam go through the right edge of the left token's merge tree
and the left edge of the right one's. All seams of a batch are followed back through these edges at once; a seam fails
where a merge rule for its two symbols ranks before the merge that took one of them away. Only words with a failing seam
are merged rule by rule.

This asks for byte-level BPE without normaliser, dropout or prefixes, in which each token is made by one rule; other
tokenizers are refused, and tokens made by several rules (or by none) send their words to exact merging.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm import textblocks as tb
from hazardframe.llm.tokenfile import _byte_characters, _piece_starts

MAX_PIECE = 64  # longer pieces are not remembered
MAX_REMEMBERED = 200_000  # pieces
MAX_REMEMBERED_IDS = 2_000_000
NEVER = np.int64(1 << 40)


class _Table:
    """Numbers looked up by 64-bit keys, a whole array at a time (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # the last of those that meet in a slot stays
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tb.mixed(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that are not there."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        more = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & int(self.mask)
            seen = self.keys[slot[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (seen >= 0)]
        return out


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` in a row."""
    return values[np.repeat(begin, size) + tb.segment_arange(size)]


def _assembled(count: int, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists numbered 0 to count - 1 in a row, and their sizes, from parts of (numbers, values in a row, sizes)."""
    sizes = np.zeros(count, np.int64)
    for numbers, _, n in parts:
        sizes[numbers] = n
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    for numbers, values, n in parts:
        out[np.repeat(begin[numbers], n) + tb.segment_arange(n)] = values
    return out, sizes


class Vocabulary:
    """Tokens, merge rules and the checks of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        plain = (
            before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and model["type"] == "BPE"
            and kind.get("normalizer") is None and kind.get("post_processor") is None and (kind.get("decoder") or {}).get("type") == "ByteLevel"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in kind["added_tokens"])
        )
        alphabet = _byte_characters()
        self.bytes_of = {c: b for b, c in alphabet.items()}
        to_latin = {ord(c): b for b, c in alphabet.items()}
        self.to_latin = to_latin
        if not plain or any(c not in model["vocab"] for c in alphabet.values()):
            raise ValueError(f"{path} is not a byte-level BPE of the kind that can be checked at its seams")
        self.added = {t["content"].encode(): t["id"] for t in kind["added_tokens"]}
        self.added_pattern = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None

        count = max([*model["vocab"].values(), *self.added.values()]) + 1
        spelled = [b""] * count
        for token, i in model["vocab"].items():
            known = all(c in self.bytes_of for c in token)
            spelled[i] = token.translate(to_latin).encode("latin-1") if known else token.encode()
        for content, i in self.added.items():
            spelled[i] = content
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = np.array([model["vocab"][alphabet[b]] for b in range(256)], np.int64)

        # Rules: the two halves and the rank of the one that makes a token; bytes are there from the start (rank -1).
        vocab = model["vocab"]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, whole = (np.array(x, np.int64) for x in zip(*rules)) if rules else (np.zeros(0, np.int64),) * 3
        self.rules = _Table(left * count + right, np.arange(len(rules)))
        self.whole, self.count, self.made = whole, count, whole.tolist()
        self.rank_of = {a * count + b: r for r, (a, b, _) in enumerate(rules)}
        self.left, self.right = np.full(count, -1), np.full(count, -1)
        self.born = np.full(count, -1)
        self.left[whole], self.right[whole], self.born[whole] = left, right, np.arange(len(rules))
        ways = np.bincount(whole, minlength=count)
        ways[self.byte_ids] += 1
        sound = ways == 1
        # A token's own word is that token if its halves meet at their seam first, and the halves are such tokens too.
        self.sound = sound.copy()
        one = np.flatnonzero(sound & (self.born >= 0))
        self.sound[one] = self._first_merge(self.left[one], self.right[one]) == self.born[one]
        while True:
            held = self.sound[one] & self.sound[self.left[one]] & self.sound[self.right[one]]
            if (held == self.sound[one]).all():
                break
            self.sound[one] = held

        nodes: dict[bytes, int] = {b"": 0}
        ids, edges = [-1], []
        for token in set(vocab.values()) - set(self.added.values()):
            text = spelled[token]
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    edges.append((nodes[text[: n - 1]] * 256 + text[n - 1], len(nodes)))
                    nodes[text[:n]] = len(nodes)
                    ids.append(-1)
            ids[nodes[text]] = token
        self.node_ids = np.array(ids, np.int64)
        self.edges = _Table(*(np.array(x, np.int64) for x in zip(*edges)))

    def _first_merge(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Rank of the earliest merge across the seam of each pair of tokens, while both would form by themselves; -1 for none."""
        out = np.full(len(u), -1)
        at, u, v = np.arange(len(u)), u.copy(), v.copy()
        gone_u, gone_v = np.full(len(u), NEVER), np.full(len(u), NEVER)
        while len(at):
            m = self.rules.get(u * self.count + v)
            # Of equal ranks the leftmost merge comes first.
            cross = (m >= 0) & (m < gone_u) & (m <= gone_v)
            out[at[cross]] = m[cross]  # going back in time, an earlier one replaces it
            back_v = (self.born[v] >= self.born[u]) & (self.born[v] >= 0)
            back_u = ~back_v & (self.born[u] >= 0)
            gone_v, v = np.where(back_v, self.born[v], gone_v), np.where(back_v, self.left[v], v)
            gone_u, u = np.where(back_u, self.born[u], gone_u), np.where(back_u, self.right[u], u)
            on = back_u | back_v
            at, u, v, gone_u, gone_v = at[on], u[on], v[on], gone_u[on], gone_v[on]
        return out

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each byte the longest token before ``stop``, and its length."""
        ids, sizes = np.full(len(data), -1), np.zeros(len(data), np.int64)
        at, node, n = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            node = self.edges.get(node * 256 + data[at + n])
            at, node = at[node >= 0], node[node >= 0]
            n += 1
            token = self.node_ids[node]
            ids[at[token >= 0]], sizes[at[token >= 0]] = token[token >= 0], n
            inner = at + n < stop[at]
            at, node = at[inner], node[inner]
        return ids, sizes

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of the given sizes that fill ``data``: all in a row, and how many each word has."""
        stop = np.cumsum(size)
        ids, sizes = self.longest(data, np.repeat(stop, size))
        # Where the proposed tokens begin: follow all words at once, the last long ones by themselves.
        begin = np.zeros(len(data), bool)
        at, end = (stop - size)[size > 0], stop[size > 0]
        while len(at) > 32:
            begin[at] = True
            at = at + sizes[at]
            inner = at < end
            at, end = at[inner], end[inner]
        for a, e in zip(at.tolist(), end.tolist()):
            step, place = sizes[a:e].tolist(), 0
            while place < e - a:
                begin[a + place] = True
                place += step[place]
        place = np.flatnonzero(begin)
        token = ids[place]
        owner = np.searchsorted(stop, place, "right")
        wrong = np.zeros(len(size), bool)
        wrong[owner[~self.sound[token]]] = True
        seam = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, inverse = np.unique(token[seam] * self.count + token[seam + 1], return_inverse=True)
        bad = self._first_merge(pairs // self.count, pairs % self.count) >= 0
        wrong[owner[seam[bad[inverse]]]] = True
        right = ~wrong[owner]
        parts = [(np.arange(len(size))[~wrong], token[right], np.bincount(owner[right], minlength=len(size))[~wrong])]
        return _assembled(len(size), parts + self._merged(data, stop - size, size, np.flatnonzero(wrong)))

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Words by merging, lowest rank first, then leftmost: short ones of like length together, a merge of each in
        every step; long ones by themselves. (words, their ids in a row, number of ids of each) of each group."""
        out, low = [], 0
        for high in (4, 6, 8, 11, 16, 24, 40, 64):
            some = words[(size[words] > low) & (size[words] <= high)]
            low = high
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                out.append((part, *self._merged_together(_gathered(data, begin[part], size[part]), size[part], high)))
        for k in words[size[words] > low].tolist():
            ids = self._merged_alone(data[begin[k] : begin[k] + size[k]])
            out.append((np.array([k]), ids, np.array([len(ids)])))
        return out

    def _merged_together(self, data: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(size), width + 1), -1)  # a column to spare, for what has nothing behind it
        ids[:, :width][np.arange(width) < size[:, None]] = self.byte_ids[data]
        rank = np.full((len(size), width), NEVER)
        both = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        rank[both] = self._rank(ids[:, :-1][both], ids[:, 1:][both])
        row, columns = np.arange(len(size)), np.arange(width)
        done = ids.copy()
        while True:
            place = rank.argmin(axis=1)
            least = rank[np.arange(len(rank)), place]
            on = least < NEVER
            if not on.all():
                done[row[~on]] = ids[~on]
                row, ids, rank, place, least = row[on], ids[on], rank[on], place[on], least[on]
            if not len(row):
                break
            k = np.arange(len(row))
            shift = columns[None, :] > place[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            ids[k, place] = self.whole[least]
            rank[k, place] = self._rank(ids[k, place], ids[k, place + 1])
            inner = place > 0
            rank[k[inner], place[inner] - 1] = self._rank(ids[k[inner], place[inner] - 1], ids[k[inner], place[inner]])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the rule for each pair, NEVER without one; -1 stands for no token."""
        rank = self.rules.get(np.where((left >= 0) & (right >= 0), left * self.count + right, 0))
        return np.where((rank >= 0) & (left >= 0) & (right >= 0), rank, NEVER)

    def _merged_alone(self, word: np.ndarray) -> np.ndarray:
        ids = self.byte_ids[word].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rules, count = self.rank_of, self.count
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rules.get(a * count + b)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is part of another token by now
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((i, k), (before[i], i)):
                if x >= 0 and y < n and (r := rules.get(ids[x] * count + ids[y])) is not None:
                    heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return np.array([t for t in ids if t >= 0])


# Kinds of bytes whose words the splitting pattern tells without looking further: letters (ASCII and U+00C0 to U+00FF),
# digits, other visible characters. The apostrophe is left out, because of the pattern's contractions.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = 0
_BEHIND_C3 = np.zeros(256, bool)
_BEHIND_C3[0x80:0xC0] = True
_BEHIND_C3[[0x97, 0xB7]] = False  # the multiplication and division signs


class Speculator:
    """Ids of whole texts. Texts are cut into pieces that no token crosses; each distinct piece of a slice is worked on
    once, and a bounded table remembers pieces between slices (by 64-bit hashes of their bytes)."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.kind = _KIND.copy()
        self.kind[[c[0] for c in self.vocabulary.added]] = 0
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, piece: bytes) -> list[bytes | int]:
        """The words of a piece in order; an id where the piece holds an added token."""
        v = self.vocabulary
        if v.added_pattern is not None and (found := list(v.added_pattern.finditer(piece))):
            out, at = [], 0
            for m in found:
                out += [*self.units(piece[at : m.start()]), v.added[m.group()]]
                at = m.end()
            return out + self.units(piece[at:])
        return [w.translate(v.to_latin).encode("latin-1") for w, _ in v.tokenizer.pre_tokenizer.pre_tokenize_str(piece.decode())] if piece else []

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, in a row, and their number for each piece."""
        kind = self.kind[data]
        pair = (data[:-1] == 0xC3) & _BEHIND_C3[data[1:]]
        kind[:-1][pair] = kind[1:][pair] = _LETTER
        strange = np.concatenate([[0], np.cumsum(kind == 0)])
        inner = starts + ((data[starts] == 32) & (ends - starts > 1))
        simple = (strange[ends] == strange[inner]) | ((ends - starts == 1) & (data[starts] < 128))
        s, e, i = starts[simple], ends[simple], inner[simple]
        # A word begins with its piece (a blank belongs to what follows it), and where the kind changes.
        at = np.repeat(s, e - s) + tb.segment_arange(e - s)
        first = np.repeat(s, e - s) == at
        change = first | ((at > np.repeat(i, e - s)) & (kind[at] != kind[at - 1]))
        begin = at[change]
        owner = np.repeat(np.flatnonzero(simple), e - s)[change]
        last = np.append(owner[1:] != owner[:-1], True)
        stop = np.where(last, ends[owner], np.append(begin[1:], 0))
        fixed = np.full(len(begin), -1)
        # The other pieces are split by the tokenizer; their words follow behind the data.
        others, raw = np.flatnonzero(~simple), data.tobytes()
        units = [self.units(raw[a:b]) for a, b in zip(starts[others].tolist(), ends[others].tolist())]
        if units:
            listed = [u for own in units for u in own]
            words = [u if isinstance(u, bytes) else b"" for u in listed]
            size = np.fromiter(map(len, words), np.int64, len(words))
            data = np.concatenate([data, np.frombuffer(b"".join(words), np.uint8)])
            far = len(raw) + np.cumsum(size)
            begin, stop = np.concatenate([begin, far - size]), np.concatenate([stop, far])
            owner = np.concatenate([owner, np.repeat(others, [len(own) for own in units])])
            fixed = np.concatenate([fixed, [-1 if isinstance(u, bytes) else u for u in listed]])
            order = np.argsort(owner, kind="stable")
            begin, stop, owner, fixed = begin[order], stop[order], owner[order], fixed[order]
        key = tb.range_hash(tb.prefix_hash(data), begin, np.minimum(stop, begin + MAX_PIECE))
        long = np.flatnonzero(stop - begin > MAX_PIECE)
        key[long] = np.arange(len(long), dtype=np.uint64)
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        size = (stop - begin)[one]
        ids, n = self.vocabulary.words(_gathered(data, begin[one], size), size)
        of = np.cumsum(n) - n
        ids, of, n = np.concatenate([ids, fixed]), np.where(fixed >= 0, len(ids) + np.arange(len(fixed)), of[inverse]), np.where(fixed >= 0, 1, n[inverse])
        return _gathered(ids, of, n), np.bincount(owner, weights=n, minlength=len(starts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text. NULL is an empty text."""
        data, offsets = tb.text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = _piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        key = tb.range_hash(tb.prefix_hash(data), starts, np.minimum(ends, starts + MAX_PIECE))
        long = np.flatnonzero(ends - starts > MAX_PIECE)
        key[long] = np.arange(len(long), dtype=np.uint64)  # kept apart from all others, and not remembered
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.keys[place] == keys) & (keys >= len(long)) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[known], size[known] = self.begin[place[known]], self.size[place[known]]
        if len(new):
            ids, size[new] = self._new(data, starts[first[new]], ends[first[new]])
            begin[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
            ids = np.concatenate([self.ids, ids])
            new = new[keys[new] >= len(long)]
            if len(self.keys) + len(new) > MAX_REMEMBERED or len(ids) > MAX_REMEMBERED_IDS:  # from now on what this slice holds
                kept = np.flatnonzero(keys >= len(long))[:MAX_REMEMBERED]
                self.keys, self.size, self.ids = keys[kept], size[kept], _gathered(ids, begin[kept], size[kept])
                self.begin = np.cumsum(self.size) - self.size
            else:
                order = np.argsort(both := np.concatenate([self.keys, keys[new]]))
                self.keys, self.ids = both[order], ids
                self.begin, self.size = np.concatenate([self.begin, begin[new]])[order], np.concatenate([self.size, size[new]])[order]
        else:
            ids = self.ids
        n = size[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        return _gathered(ids, begin[inverse], n).astype(np.uint32), np.diff(upto[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def speculator(path: str) -> Speculator:
    return Speculator(path)


def encode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each whole text as the tokenizers library gives them without special tokens: id, n_tokens, ids
    (little-endian unsigned 32-bit integers); added tokens that stand in a text are found like there.

    One row for each row of ``df``, without a shuffle; other columns are left out, whatever their names. NULL and empty
    texts have no ids; repeated rows and NULL ids stay; an empty table gives an empty one. Memory follows the longest text.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1), 2 << 20):
                ids, counts = speculator(tokenizer).encode(batch.column(1).slice(lo, hi - lo))
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(4)
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), packed], names=["id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decoded(vocabulary: Vocabulary, column: pa.Array) -> pa.Array:
    """Texts of packed ids. Ids beyond the vocabulary give nothing, broken UTF-8 gives replacement characters."""
    column = pc.fill_null(column, b"")
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)
    known = ids < len(vocabulary.sizes)
    ids = np.where(known, ids, 0)
    size = np.where(known, vocabulary.sizes[ids], 0)
    raw = vocabulary.spelled[np.repeat(vocabulary.begins[ids], size) + tb.segment_arange(size)]
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    packed = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(raw)])
    try:
        return packed.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in packed.to_pylist()], pa.string())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with the text of its ids, special tokens included. NULL ids give an empty text."""
    rows = encoded.select("id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(2), 2 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(speculator(tokenizer).vocabulary, part.column(2))], names=["id", "n_tokens", "ids", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary, text string")
