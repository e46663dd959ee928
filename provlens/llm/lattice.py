"""Language-model scores from a subword lattice.

Text is lower-cased (A-Z), cut into words, and a text is its words and one end.
A word is spelled with a word mark in front, and every way of cutting it into
pieces of an existing vocabulary is a path through a lattice whose arcs weigh
the pieces' unigram log probabilities; one more arc spans a word that training
has seen, so a word is also a piece of its own. The score of a word is the sum
over all its paths, computed by a forward recursion in log space; a text's score
is the sum over its words plus the end's, as no piece crosses words. A character
can always be spelled by the vocabulary's byte pieces, so every text has a
probability above zero.

Weights. The pieces start from the vocabulary's own scores (a merge-ordered
vocabulary has ranks for scores; they are read as a Zipf distribution) and are
fitted to the training documents by expectation maximisation: expected piece
counts from the forward and backward recursions over all distinct training
words, with the starting weights as a prior of ``PRIOR`` pieces. The arc of a
word seen ``c`` times in ``N`` training tokens weighs ``(c - D) / N``; the
discounts ``D`` of all words together, ``D * V / N``, weigh the paths through
pieces, so that all probabilities sum to one. ``D`` is ``n1 / (n1 + 2 * n2)``,
from the numbers of words seen once and twice.

On Spark: words are counted per batch and summed by word (one row per distinct
word), and everything after that - EM and scores - works on distinct words. Per
round only the expected counts come to the driver, one number per vocabulary
piece. To score documents, words of at most ``COMMON_BYTES`` bytes with at least
1/``FREQUENT`` of all training tokens (so at most ``FREQUENT`` of them, whatever
the corpus) go to the tasks; each document's other words are joined with the
table of words, each word once for all documents of a batch. A word above ``LONG_WORD`` characters is scanned in windows: its
lattice is never held whole, only two numbers per character are.

``word_report`` says how both models do on words seen and not seen in training,
and how much of the probability comes from the whole-word arcs.

The base score is an add-one unigram model over words: per token
``log10((c + 1) / (N + V + 1))``.

Defined cases: a null text is empty and scores the end alone; a row without an
id counts as training; repeated rows are scored (and counted) each; without
training documents the vocabulary's own weights score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import filled, saved
from provlens.llm.runindex import BASE, INVERSE, Hashes, mixed

FOLDS, HELD_OUT = 7, 2
ROUNDS = 3
PRIOR = 1000.0
FREQUENT = 100_000
BATCH_BYTES = 4 << 20
WORD_BATCH = 1 << 20  # characters of words taken together
WORDS_HELD = 400_000  # distinct words a task holds before it passes their counts on
TEXT_HELD = 128 << 20  # bytes of text whose words a task holds before it passes their counts on
LATTICE_CELLS = 1 << 16  # characters of words in one set of lattices
LONG_WORD = 4096  # characters; longer words are scanned
SCAN = 1 << 15  # characters of a long word looked up at a time
COMMON_BYTES = 200  # bytes of a word that travels with the tasks
MARK = "▁"
END = " </s>"  # holds a blank, so it is no word


class Pieces:
    """The vocabulary of a SentencePiece file, as a lattice over words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        names, scores, byte_at = [], [], {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_at[int(model.id_to_piece(i)[1:-1], 16)] = None
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                # only what can occur in a lower-cased word: one mark, in front
                if MARK not in piece[1:] and not any("A" <= c <= "Z" for c in piece) and not set(piece) & set(" \t\n\v\f\r"):
                    names.append(piece)
                    scores.append(model.get_score(i))
        if len(byte_at) != 256:
            raise ValueError("the vocabulary needs a piece for every byte")
        self.names = names
        self.size = len(names) + 256 + 1  # pieces, bytes, end
        self.end = self.size - 1
        scores = np.array(scores)
        start = np.full(self.size, 1e-6)
        if (scores <= -100).mean() > 0.5:  # ranks, not log probabilities
            start[:len(names)] = 1.0 / (10.0 - scores)
        else:
            start[:len(names)] = np.exp(scores)
        start[self.end] = start[:len(names)].sum() / 200
        self.start = start / start.sum()
        lengths = np.array([len(x) for x in names])
        self.longest = int(lengths.max())
        self.table = []  # by length: sorted hashes and the pieces they belong to
        for n in range(1, self.longest + 1):
            which = np.flatnonzero(lengths == n)
            text = np.frombuffer("".join(names[i] for i in which).encode("utf-32-le"), "<u4")
            h = PointHashes(text).of(0, np.arange(len(which)) * n, n) if len(which) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            self.table.append((h[order], which[order].astype(np.int64)))

    def lattices(self, words: Sequence[str], log_p: np.ndarray,
                 whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, dict]]:
        """Lattices of words of one length side by side, long words left out:
        (places in ``words``, lattice). ``weight[n][k, i]`` is the arc of word k
        from character i over n characters (minus infinity where there is no
        such piece), ``piece[n]`` its piece, ``bytes`` the arcs that spell one
        character by its bytes, ``whole`` the arc over all of the word."""
        size = np.array([len(w) + 1 for w in words], np.int64)  # with the mark
        order = np.argsort(size, kind="stable")
        order = order[:np.searchsorted(size[order], LONG_WORD, "right")]
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for which in np.split(order, cuts) if len(order) else []:
            m = int(size[which[0]])
            step = max(1, LATTICE_CELLS // m)
            for low in range(0, len(which), step):
                part = which[low:low + step]
                points = code_points("".join(MARK + words[k] for k in part))
                s = self.lattice(points.reshape(len(part), m), log_p)
                s["whole"] = np.full(len(part), -np.inf) if whole is None else whole[part]
                yield part, s

    def lattice(self, points: np.ndarray, log_p: np.ndarray) -> dict:
        rows, m = points.shape
        hashes = PointHashes(points.ravel())
        first = np.arange(rows)[:, None] * m
        weight, piece = {}, {}
        for n, (known, which) in enumerate(self.table[:m], 1):
            if not len(known):
                continue
            h = hashes.of(0, first + np.arange(m - n + 1), n)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            if hit.any():
                piece[n] = np.where(hit, which[i], -1)
                weight[n] = np.where(hit, log_p[which[i]], -np.inf)
        distinct, back = np.unique(points, return_inverse=True)
        cost = np.array([sum(log_p[len(self.names) + b] for b in chr(c).encode("utf-8")) for c in distinct.tolist()])
        return {"weight": weight, "piece": piece, "bytes": cost[back].reshape(rows, m), "points": points}

    def forward(self, s: dict, through: float = 0.0) -> np.ndarray:
        """Log-space forward recursion: ``alpha[k, j]`` is the log of the sum
        over all paths of word k to its boundary j. Paths through pieces weigh
        ``through``; the whole word's arc leads past them to the end."""
        rows, m = s["points"].shape
        alpha = np.full((rows, m + 1), -np.inf)
        alpha[:, 0] = through
        for j in range(1, m + 1):
            ways = [alpha[:, j - 1] + s["bytes"][:, j - 1]]
            ways += [alpha[:, j - n] + w[:, j - n] for n, w in s["weight"].items() if n <= j]
            if j == m:
                ways.append(s["whole"])
            alpha[:, j] = log_sum(ways)
        return alpha

    def backward(self, s: dict) -> np.ndarray:
        """The same from a boundary of the word to its end, pieces only."""
        rows, m = s["points"].shape
        beta = np.full((rows, m + 1), -np.inf)
        beta[:, m] = 0.0
        for i in range(m - 1, -1, -1):
            ways = [beta[:, i + 1] + s["bytes"][:, i]]
            ways += [beta[:, i + n] + w[:, i] for n, w in s["weight"].items() if i + n <= m]
            beta[:, i] = log_sum(ways)
        return beta

    def arcs(self, points: np.ndarray, log_p: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
        """The arcs of a long word that start at characters ``low`` to ``low +
        SCAN``: (start, length, weight, piece) by start; piece -1 is a character
        spelled by its bytes."""
        here = min(SCAN, len(points) - low)
        s = self.lattice(points[None, low:low + here + self.longest - 1], log_p)
        start, size = [np.arange(here)], [np.ones(here, np.int64)]
        weight, piece = [s["bytes"][0, :here]], [np.full(here, -1)]
        for n, found in s["piece"].items():
            at = np.flatnonzero(found[0, :here] >= 0)
            start.append(at)
            size.append(np.full(len(at), n))
            weight.append(s["weight"][n][0, at])
            piece.append(found[0, at])
        order = np.argsort(np.concatenate(start), kind="stable")
        start, size, weight, piece = (np.concatenate(x)[order] for x in (start, size, weight, piece))
        return start, size, weight, piece

    def scan_forward(self, points: np.ndarray, log_p: np.ndarray, through: float = 0.0) -> np.ndarray:
        """``forward`` of one long word, a window of arcs at a time."""
        alpha = np.full(len(points) + 1, -np.inf)
        alpha[0] = through
        for low in range(0, len(points), SCAN):
            start, size, weight, _ = self.arcs(points, log_p, low)
            a = alpha[low:low + SCAN + self.longest].tolist()
            for i, j, w in zip(start.tolist(), (start + size).tolist(), weight.tolist()):
                a[j] = log_add(a[j], a[i] + w)
            alpha[low:low + len(a)] = a
        return alpha

    def scan_backward(self, points: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        beta = np.full(len(points) + 1, -np.inf)
        beta[-1] = 0.0
        for low in reversed(range(0, len(points), SCAN)):
            start, size, weight, _ = (x[::-1] for x in self.arcs(points, log_p, low))
            b = beta[low:low + SCAN + self.longest].tolist()
            for i, j, w in zip(start.tolist(), (start + size).tolist(), weight.tolist()):
                b[i] = log_add(b[i], w + b[j])
            beta[low:low + len(b)] = b
        return beta

    def scores(self, words: Sequence[str], log_p: np.ndarray, through: float = 0.0,
               whole: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word, all paths summed: those through
        pieces, which weigh ``through``, and word k's own arc ``whole[k]``."""
        out = np.zeros(len(words))
        for part, s in self.lattices(words, log_p, whole):
            out[part] = self.forward(s, through)[:, -1]
        for k, points in long_words(words):
            out[k] = self.scan_forward(points, log_p, through)[-1]
            if whole is not None:
                out[k] = log_add(out[k], whole[k])
        return out

    def expected(self, words: Sequence[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words seen ``counts`` times."""
        out = np.zeros(self.size)
        for part, s in self.lattices(words, log_p):
            alpha, beta = self.forward(s), self.backward(s)
            scale = np.log(counts[part]) - alpha[:, -1]
            for n, piece in s["piece"].items():
                k, i = np.nonzero(piece >= 0)
                use = np.exp(alpha[k, i] + s["weight"][n][k, i] + beta[k, i + n] + scale[k])
                out[:len(self.names)] += np.bincount(piece[k, i], use, minlength=len(self.names))
            self.add_bytes(out, s["points"].ravel(),
                           np.exp(alpha[:, :-1] + s["bytes"] + beta[:, 1:] + scale[:, None]).ravel())
        for k, points in long_words(words):
            alpha, beta = self.scan_forward(points, log_p), self.scan_backward(points, log_p)
            for low in range(0, len(points), SCAN):
                start, size, weight, piece = self.arcs(points, log_p, low)
                start += low
                use = counts[k] * np.exp(alpha[start] + weight + beta[start + size] - alpha[-1])
                named = piece >= 0
                out[:len(self.names)] += np.bincount(piece[named], use[named], minlength=len(self.names))
                self.add_bytes(out, points[start[~named]], use[~named])
        return out

    def add_bytes(self, out: np.ndarray, points: np.ndarray, use: np.ndarray) -> None:
        """A character spelled by bytes uses each of its bytes."""
        distinct, back = np.unique(points, return_inverse=True)
        for c, n in zip(distinct.tolist(), np.bincount(back.ravel(), use).tolist()):
            for b in chr(c).encode("utf-8"):
                out[len(self.names) + b] += n


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def long_words(words: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    for k, w in enumerate(words):
        if len(w) + 1 > LONG_WORD:
            yield k, code_points(MARK + w)


def log_add(x: float, y: float) -> float:
    """Log of the sum of two exponentials; one is finite."""
    return x + math.log1p(math.exp(y - x)) if x >= y else y + math.log1p(math.exp(x - y))


def log_sum(ways: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials, element by element; one is finite."""
    x = np.stack(ways)
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


class PointHashes(Hashes):
    """Substring hashes of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        powers = np.full(n + 1, BASE, np.uint64)
        self.inverse = np.full(n + 1, INVERSE, np.uint64)
        powers[0] = self.inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        self.sums = [total]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII white space only


def held_out(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % FOLDS == HELD_OUT


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out().alias("held_out"), F.encode(filled("text"), "UTF-8").alias("t"))


def _slices(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.binary_length(batch["t"]).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for low, high in zip([0, *cut], [*cut, len(size)]):
            if high > low:
                yield batch.slice(low, high - low)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, h): every token of all documents, the end included, and how
    often it occurs in training and in held-out documents."""
    end = END.encode()

    def rows(seen: Counter, other: Counter) -> pd.DataFrame:
        words = [*seen, *(w for w in other if w not in seen)]
        return pd.DataFrame({"word": [w.decode() for w in words],
                             "c": np.array([seen.get(w, 0) for w in words], np.int64),
                             "h": np.array([other.get(w, 0) for w in words], np.int64)})

    def each(batches):
        seen, other, read = Counter({end: 0}), Counter(), 0
        for pdf in batches:
            for t, out in zip(pdf["t"], pdf["held_out"]):
                into = other if out else seen
                into.update(words_of(bytes(t)))
                into[end] += 1
                read += len(t)
                if len(seen) + len(other) > WORDS_HELD or read > TEXT_HELD:
                    yield rows(seen, other)
                    seen, other, read = Counter({end: 0}), Counter(), 0
        yield rows(seen, other)

    return (_texts(docs).select("held_out", "t").mapInPandas(each, "word string, c bigint, h bigint")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h")))


def _words(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray, pd.DataFrame]]:
    """(words, counts, rows): words of similar length together, ``WORD_BATCH``
    characters at a time."""
    for pdf in batches:
        pdf = pdf.iloc[np.argsort(pdf["word"].str.len().to_numpy(), kind="stable")]
        size = np.cumsum(pdf["word"].str.len().to_numpy() + 1)
        cut = np.flatnonzero(np.diff(size // WORD_BATCH)) + 1
        for part in np.split(np.arange(len(pdf)), cut):
            if len(part):
                some = pdf.iloc[part]
                yield some["word"].tolist(), some["c"].to_numpy(), some


def fitted(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of the pieces after EM on the distinct training words
    of the table (word, c)."""
    log_p = np.log(pieces.start)
    body = words.filter((F.col("word") != END) & (F.col("c") > 0))
    for _ in range(rounds):
        def each(batches, log_p=log_p):
            total = np.zeros(pieces.size)
            for some, c, _ in _words(batches):
                total += pieces.expected(some, np.ones(len(c)), log_p)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used.astype(np.int64), "n": total[used]})

        # one number per piece of the vocabulary
        rows = body.mapInPandas(each, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = pieces.start * prior
        for r in rows:
            total[r["piece"]] += r["n"]
        log_p = np.log(total / total.sum())
    return log_p


def model(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """From the table (word, c, h) of all words: what adds to such rows the log10
    scores ``base`` and ``score`` of both models and ``arc``, the share of the
    probability that the whole word's arc gives; and the training tokens."""
    size = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"),
                     F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = size["n"] or 0, size["v"] or 0
    discount = size["once"] / (size["once"] + 2 * size["twice"]) if size["once"] else 0.5
    through = math.log(discount * v / n) if n else 0.0
    log_p = fitted(words, pieces, rounds)

    def each(batches):
        for some, c, rows in _words(batches):
            whole = np.where(c > 0, np.log(np.maximum(c - discount, 1e-300) / max(n, 1)), -np.inf)
            score = pieces.scores(some, log_p, through, whole)
            for k in (k for k, w in enumerate(some) if w == END):  # a piece of its own
                score[k] = np.logaddexp(whole[k], through + log_p[pieces.end])
            yield rows.assign(base=np.log10((c + 1) / (n + v + 1)), score=score / math.log(10),
                              arc=np.exp(whole - score))

    def weigh(some: DataFrame) -> DataFrame:
        return some.select("word", "c", "h").mapInPandas(
            each, "word string, c bigint, h bigint, base double, score double, arc double")

    return weigh, n


def word_report(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Both models on words that training has seen (``known``) and on others:
    number of tokens in training and held-out documents, log10 probability per
    held-out token, and the mean share of a token's probability that the
    whole-word arcs give. Sums over distinct words; at most two rows."""
    words = saved(word_counts(docs), "words")
    weigh, _ = model(words, Pieces(vocabulary or default_vocabulary()), rounds)

    def mean(value: str, by: str) -> Column:
        return F.try_divide(F.sum(F.col(value) * F.col(by)), F.sum(by)).alias(f"{value}_{'train' if by == 'c' else 'held_out'}")

    return weigh(words).groupBy((F.col("c") > 0).alias("known")).agg(
        F.sum("c").alias("train_tokens"), F.sum("h").alias("held_out_tokens"),
        mean("base", "h"), mean("score", "h"), mean("arc", "c"), mean("arc", "h"))


def scored(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS,
           frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    pieces = Pieces(vocabulary or default_vocabulary())
    words = saved(word_counts(docs), "words")
    weigh, n = model(words, pieces, rounds)
    is_common = ((F.col("c") > 0) & (F.col("c") * frequent >= n) & (F.octet_length("word") <= COMMON_BYTES)
                 | (F.col("word") == END))
    given = weigh(words.filter(is_common)).collect()  # at most `frequent` of them, and the end
    end = next(((r["c"], r["base"], r["score"]) for r in given if r["word"] == END), (0, 0.0, 0.0))
    given = [r for r in given if r["word"] != END]
    common = pa.array([r["word"] for r in given], pa.string())
    basic, scores = (np.array([r[x] for r in given], np.float64) for x in ("base", "score"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        """A row per document with what its common words give, and a row per
        other word of some documents: where and how often it occurs."""
        for batch in _slices(batches):
            rows, k = len(batch), batch["k"].to_numpy()
            text = pc.ascii_split_whitespace(pc.ascii_lower(batch["t"].cast(pa.string())))
            flat = text.flatten()
            is_word = pc.not_equal(flat, "")
            owner = pc.list_parent_indices(text).filter(is_word).to_numpy()
            coded = flat.filter(is_word).dictionary_encode()
            code, distinct = coded.indices.to_numpy(), coded.dictionary
            at = pc.fill_null(pc.index_in(distinct, value_set=common), -1).to_numpy()[code]
            held = at >= 0

            def total(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner[held], values[at[held]], minlength=rows)

            pairs, times = np.unique(code[~held].astype(np.int64) * rows + owner[~held], return_counts=True)
            first = np.flatnonzero(np.diff(pairs // rows, prepend=-1))
            rest = len(first)

            def column(own: pa.Array) -> pa.Array:
                return pa.concat_arrays([own, pa.nulls(rest, own.type)])

            def numbers(own: np.ndarray, dtype: type) -> pa.Array:
                return pa.array(np.concatenate([own, np.zeros(rest)]).astype(dtype))

            places = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([k, k[pairs % rows]])),
                 pa.array(np.concatenate([np.zeros(rows, np.int64), times]).astype(np.int64))], ["k", "times"])
            offsets = np.concatenate([np.arange(rows), rows + first, [rows + len(pairs)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                # a document's own row has a word that is in no table
                pa.concat_arrays([pa.array([f" {x}" for x in k.tolist()], pa.string()),
                                  distinct.take(pa.array(code[:0] if not rest else pairs[first] // rows))]),
                pa.ListArray.from_arrays(pa.array(offsets), places),
                column(batch["doc_id"]), column(batch["held_out"]),
                numbers(np.bincount(owner, minlength=rows) + 1, np.int64),
                numbers(np.bincount(owner[held], minlength=rows) + (end[0] > 0), np.int64),
                numbers(total(basic) + end[1], np.float64), numbers(total(scores) + end[2], np.float64)],
                ["word", "places", "doc_id", "held_out", "n_tokens", "n_known", "b", "s"])

    # the row number of a file scan does not depend on who reads it
    parts = _texts(docs).withColumn("k", F.monotonically_increasing_id()).mapInArrow(
        each, f"word string, places array<struct<k:bigint,times:bigint>>, doc_id {kind}, held_out boolean, "
              "n_tokens bigint, n_known bigint, b double, s double")
    rare = weigh(words.filter(~is_common)).select("word", "c", "base", "score")

    def joined(own: str, given: str) -> Column:
        return F.sum(F.col(own) + F.col("times") * F.coalesce(given, F.lit(0.0)))

    return (parts.join(rare, "word", "left")
            .select(F.inline("places"), "doc_id", "held_out", "n_tokens", "n_known", "b", "s", "c", "base", "score")
            .groupBy("k").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        joined("b", "base").alias("base_score"), joined("s", "score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                "base_score", "score"))
