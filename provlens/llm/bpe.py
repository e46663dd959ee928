"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A pre-token is a row of symbols (bytes first). The leaves of its tree are the
pairs of neighbouring symbols, each holding ``rank * width + position`` of the
pair's merge, or "none"; every inner node is the minimum of its children. The
root is therefore the lowest-ranked merge, the leftmost of equals. Applying it
changes three leaves (the pair itself, the one that began at its right symbol,
and the one before), each a path to the root. This repeats until the root holds
no merge.

Pre-tokens of equal tree width are merged side by side in NumPy (one row per
pre-token); one of over ``SIDE_BY_SIDE`` bytes gets a tree of its own, so a
text without a blank costs n log n. Results are remembered per task for at most
``REMEMBERED`` distinct pre-tokens.

Encoding follows the tokenizers library: added tokens found in a text become
their ids, the rest is cut by the byte-level pattern. Decoding joins the
tokens' bytes and reads them as UTF-8, broken sequences as U+FFFD.

Defined cases: a null text is empty and has no tokens; repeated rows are
encoded each; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import chunks, filled

# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIDE_BY_SIDE = 128
REMEMBERED = 300_000
NONE = np.iinfo(np.int32).max
ID_BITS = 20


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [shown[b] for b in range(256)]


class Bpe:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file is needed")
        if spec.get("normalizer") or pre.get("add_prefix_space") or model.get("ignore_merges") or any(
                model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("an option of this file is not supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        vocab = model["vocab"]
        shown = byte_characters()
        of = {c: b for b, c in enumerate(shown)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in shown], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << ID_BITS | vocab[b] for a, b in pairs], np.int64)
        if size > 1 << ID_BITS or len(pairs) * SIDE_BY_SIDE >= NONE:
            raise ValueError("the vocabulary is too large for packed keys")
        # pair table: a hash of the pair picks a run of neighbouring keys
        self.shift = np.uint64(64 - 18)
        bucket = self._bucket(keys)
        order = np.lexsort((keys, bucket))
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NONE).astype(np.int32)
        self.begin = np.searchsorted(bucket[order], np.arange((1 << 18) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.begin).max())
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.by_pair = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.pattern = PATTERN
        self.known: dict[str, bytes] = {}
        self.blank: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of symbol pairs, NONE where there is no merge."""
        key = left.astype(np.int64) << ID_BITS | right
        at = self.begin[self._bucket(key)]
        rank = np.where(self.keys[at] == key, self.ranks[at], np.int32(NONE))
        for i in range(1, self.depth):  # few: the table is sparse
            nxt = np.minimum(at + i, len(self.keys) - 1)
            rank = np.where(self.keys[nxt] == key, self.ranks[nxt], rank)
        return rank

    def merge_rows(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte strings of similar length, their trees side by side: all ids in
        a row, and where each string's ids end."""
        size = np.array([len(w) for w in words])
        rows, longest = len(words), int(size.max())
        width = 1 << max(0, (longest - 2).bit_length()) if longest > 1 else 1
        columns = width + 2  # symbols 0..width, and an end
        symbol = np.full((rows, columns), -1, np.int32)
        inside = np.arange(columns) < size[:, None]
        symbol[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.arange(columns) + 1, size[:, None]).astype(np.int32)  # size: the end, where symbol is -1
        before = np.tile(np.arange(columns, dtype=np.int32) - 1, (rows, 1))
        tree = np.full((rows, 2 * width), NONE, np.int32)
        at = np.arange(width, dtype=np.int32)

        def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            some = rank != NONE
            return np.where(some, np.where(some, rank, 0) * np.int32(width) + place, np.int32(NONE))

        right = symbol[:, 1:width + 1]
        rank = np.where(right < 0, np.int32(NONE), self.rank_of(symbol[:, :width], np.maximum(right, 0)))
        tree[:, width:] = leaf(rank, at)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        who = np.flatnonzero(tree[:, 1] != NONE)
        while len(who):
            best = tree[who, 1]
            i = best % width
            j = after[who, i]
            k = after[who, j]
            symbol[who, i] = self.result[best // width]
            symbol[who, j] = -2  # merged away
            after[who, i] = k
            before[who, k] = i  # for the end a value that is never read
            tail = symbol[who, k]
            here = np.where(tail < 0, np.int32(NONE), self.rank_of(symbol[who, i], np.maximum(tail, 0)))
            p = before[who, i]
            lead = np.maximum(p, 0)
            back = np.where(p < 0, np.int32(NONE), self.rank_of(np.maximum(symbol[who, lead], 0), symbol[who, i]))
            # three leaves, then their paths to the root; where there is no pair before, i is written again
            gone = j < width
            tree[who[gone], width + j[gone]] = NONE
            tree[who, width + i] = leaf(here, i)
            some = p >= 0
            tree[who[some], width + p[some]] = leaf(back[some], p[some])
            nodes = [width + i, width + np.minimum(j, width - 1), width + lead]
            while (nodes[0] > 1).any():
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[who, x] = np.minimum(tree[who, 2 * x], tree[who, 2 * x + 1])
            who = who[tree[who, 1] != NONE]
        kept = (symbol >= 0) & inside
        return symbol[kept], np.cumsum(kept.sum(axis=1))

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one long byte string: the same tree, as a list."""
        n, none = len(word), int(NONE)
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        width = 1 << max(0, (n - 2).bit_length())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        by_pair, result = self.by_pair, self.result

        def set_leaf(i: int, value: int) -> None:
            x = width + i
            tree[x] = value
            while x > 1:
                x >>= 1
                a, b = tree[2 * x], tree[2 * x + 1]
                least = a if a < b else b
                if tree[x] == least:
                    break
                tree[x] = least

        def value(i: int) -> int:
            j = after[i]
            rank = by_pair.get(symbol[i] << ID_BITS | symbol[j]) if j < n else None
            return none if rank is None else rank * width + i

        for i in range(n - 1):
            tree[width + i] = value(i)
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            symbol[i] = int(result[rank])
            symbol[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                set_leaf(j, none)
            set_leaf(i, value(i))
            if before[i] >= 0:
                set_leaf(before[i], value(before[i]))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def learn(self, words: set[str]) -> None:
        """Ids of pre-tokens, as little-endian bytes, into ``known``."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) > SIDE_BY_SIDE:
                self.known[word] = self.merge_one(raw).astype("<u4").tobytes()
            else:
                classes.setdefault(max(2, (len(raw) - 2).bit_length()), []).append((word, raw))
        for bits, items in classes.items():
            step = max(256, (1 << 21) >> bits)
            for low in range(0, len(items), step):
                part = items[low:low + step]
                ids, ends = self.merge_rows([raw for _, raw in part])
                flat, begin = ids.astype("<u4").tobytes(), 0
                for (word, _), end in zip(part, (4 * ends).tolist()):
                    self.known[word] = flat[begin:end]
                    begin = end

    def pieces(self, texts: Sequence[str]) -> list[tuple[list[str], bool]]:
        """Cut texts at blanks, (pieces, True) with the blank before every piece
        but the first left out: no pre-token reaches over a blank, except in a
        run of white space that goes on after it. Texts with such a run are cut
        into their pre-tokens, (pre-tokens, False)."""
        run = regex.compile(r"\s (?!\S)").search
        cut = regex.compile(self.pattern).findall
        return [(cut(text), False) if run(text) else (text.split(" "), True) for text in texts]

    def look_up(self, split: list[tuple[list[str], bool]]) -> None:
        """Bring everything in ``split`` into the two tables: ``known`` for
        pre-tokens, ``blank`` for pieces with a blank before them."""
        if len(self.known) + len(self.blank) > REMEMBERED:
            self.known.clear()
            self.blank.clear()
        cut = regex.compile(self.pattern).findall
        whole, after_blank = set(), set()
        for parts, at_blanks in split:
            if at_blanks:
                after_blank.update(parts[1:])
            else:
                whole.update(parts)
        # a piece of letters alone (most are) is one pre-token
        pieces = [(w, [" " + w] if w.isalpha() else cut(" " + w)) for w in after_blank.difference(self.blank)]
        heads = [(w, cut(w)) for w in {parts[0] for parts, at_blanks in split if at_blanks}]
        for _, words in (*pieces, *heads):
            whole.update(words)
        self.learn({w for w in whole if w not in self.known})
        get = self.known.__getitem__
        for w, words in pieces:
            self.blank[w] = b"".join(map(get, words))
        self.heads = {w: b"".join(map(get, words)) for w, words in heads}

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text, as little-endian unsigned integers."""
        marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")"
                              ) if self.added else None
        cut = [marks.split(text) if marks else [text] for text in texts]
        split = self.pieces([part for parts in cut for part in parts[::2]])
        self.look_up(split)
        known, blank = self.known.__getitem__, self.blank.__getitem__
        ids = iter([self.heads[p[0]] + b"".join(map(blank, p[1:])) if at_blanks else b"".join(map(known, p))
                    for p, at_blanks in split])
        return [np.frombuffer(b"".join(self.added[part].to_bytes(4, "little") if i % 2 else next(ids)
                                       for i, part in enumerate(parts)), "<u4") for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None, keys: Sequence[str] = ("doc_id",),
            text: str = "text", with_ids: bool = True) -> DataFrame:
    """Keys, ``n_tokens``, ``ids`` (array<int>, if asked for), and the SHA-256
    of the ids and of the text decoded from them."""
    bpe = Bpe(vocabulary or default_vocabulary())  # read once, on the driver; its size is the vocabulary's
    src = docs.select(*[F.col(f"`{k}`") for k in keys], filled(text).alias("__t"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]
                       + ["n_tokens bigint"] + ["ids array<int>"] * with_ids
                       + ["ids_sha256 string", "decoded_sha256 string"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "__t"):
            ids = bpe.encode(pdf["__t"].tolist())
            out = {k: pdf[k] for k in keys}
            out["n_tokens"] = np.array([len(x) for x in ids], np.int64)
            if with_ids:
                out["ids"] = [x.astype(np.int32) for x in ids]
            out["ids_sha256"] = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            out["decoded_sha256"] = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            yield pd.DataFrame(out)

    return src.mapInPandas(each, schema)


def decoded(tokens: DataFrame, vocabulary: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of the column of ids (null: empty) in ``text``."""
    bpe = Bpe(vocabulary or default_vocabulary())

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "" if x is None else bpe.decode(np.asarray(x)))

    return tokens.withColumn(text, back(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded(docs, vocabulary, with_ids=False)
