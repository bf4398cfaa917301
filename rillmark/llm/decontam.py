"""Benchmark decontamination with an FM-index of each shard of training text.

The phrases are the windows of the benchmark: 13 consecutive words of an item, or the whole item where it has fewer. A shard
is a piece of a partition (some MB of whole documents), so nothing is shuffled. Its words become numbers: the words that
phrases use get one each, all others, and the gaps between documents, are 0. From that sequence each shard makes a suffix
order (prefix doubling), the Burrows-Wheeler transform, a wavelet tree over it with rank counts, and a sample of suffix
positions. All phrases are searched backwards at once; the hits are located by walking back to a sampled position, compared
with the bytes of the text, and merged to spans.

Numbers 0 in a row are kept as one (their places are remembered): no phrase contains 0, so no hit is lost. Phrases are
broadcast in blocks of at most PHRASE_BYTES of text (or of one item); a larger benchmark takes one more pass for each block,
each adding to the spans of the written result of the last, with the same result. The driver holds one block at a time.

Defined cases: null texts and texts without words have no words, no hits and are clean; equal items count each with its own
item_id; items without words are no phrases; a null item_id is written as an empty string; repeated rows are each returned;
an empty benchmark leaves all documents clean; an empty documents table gives an empty result. Other columns of the documents pass through decontaminate() and
removed_spans() whatever they are called; mark() adds n_words, spans and items in place of columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._shared import apart, written
from rillmark.llm._tokens import NOT_ALNUM, Words, buffers, pieces

WINDOW = 13
PHRASE_BYTES = 8 << 20
SAMPLE = 16
SHARD_BYTES = 4 << 20


class Phrases:
    """The windows of a block of items: words as numbers, the windows that are searched, and which items have each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(*buffers(pa.array([text for _, text in items], pa.string())), NOT_ALNUM)
        windows: dict[bytes, list[int]] = {}
        tokens: dict[bytes, tuple[int, ...]] = {}
        self.items = [name for name, _ in items]
        self.vocabulary = np.unique(words.hash)
        number = np.searchsorted(self.vocabulary, words.hash) + 1
        for i in range(len(items)):
            a, b = words.first[i], words.first[i + 1]
            for k in range(a, max(b - window, a) + 1 if b > a else a):
                end = min(k + window, b)
                key = b" ".join(words.text(x, x) for x in range(k, end))
                tokens[key] = tuple(number[k:end])
                windows.setdefault(key, []).append(i)
        self.keys = list(windows)
        self.tokens = [tokens[k] for k in self.keys]
        self.owners = [sorted(set(windows[k])) for k in self.keys]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        # Backward search reads the windows from their last word; -1 where a shorter one has ended.
        self.reversed = np.full((len(self.keys), self.lengths.max(initial=0)), -1, dtype=np.int64)
        for i, t in enumerate(self.tokens):
            self.reversed[i, : len(t)] = t[::-1]


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling. The last symbol must be the only smallest.

    The first round sorts by as many symbols as fit into 62 bits. Each further round takes the suffixes that are still
    tied, in their places, and sorts them by the rank of what follows the tied part, which doubles.
    """
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, bits = len(rank), max(int(rank.max(initial=0)).bit_length(), 1)
    step = max(62 // bits, 1)
    padded = np.concatenate([rank, np.zeros(step, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(step):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key)
    rank, tied = _ranks(order, key[order], np.arange(n), np.empty(n, np.int64))
    while len(tied):
        at = order[tied]
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        by = np.argsort(key)
        order[tied] = at[by]
        rank, still = _ranks(order[tied], key[by], tied, rank)
        tied, step = still, step * 2
    return order


def _ranks(suffixes: np.ndarray, keys: np.ndarray, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets the rank of each suffix to the first place of its equals; with the places that are still tied."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    rank[suffixes] = places[new][group]
    alone = new & np.concatenate([new[1:], [True]])
    return rank, places[~alone]


class WaveletTree:
    """Levels of bits, most significant first (as a wavelet matrix), with counts: rank(symbol, i) = how often it occurs before i. Whole arrays of queries at once."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(int(symbols.max(initial=0)).bit_length(), 1)
        self.ones, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(at)
        for k, level in enumerate(reversed(range(self.depth))):
            one = ((symbol >> level) & 1) == 1
            a, b = self.ones[k][begin], self.ones[k][at]
            begin = np.where(one, self.zeros[k] + a, begin - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return at - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.depth):
            one = self.ones[k][at + 1] - self.ones[k][at]
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[k] + self.ones[k][at], at - self.ones[k][at])
        return out


class FMIndex:
    def __init__(self, sequence: np.ndarray):
        """sequence: numbers from 1; 0 is put at the end."""
        sequence = np.concatenate([sequence, [0]])
        order = suffix_order(sequence)
        before = sequence[order - 1]
        self.tree = WaveletTree(before)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence))])
        self.sampled = np.flatnonzero(order % SAMPLE == 0)
        self.positions = order[self.sampled]
        self.n = len(sequence)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row (a pattern from its last symbol, -1 after its first) the range of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(patterns[live, k] >= 0) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, k]
            known = c + 1 < len(self.starts)
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live], high[live] = self.starts[c] + self.tree.rank(c, low[live]), self.starts[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows of the order: back to a sampled one, step by step."""
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        at = rows.copy()
        while len(live):
            k = np.minimum(np.searchsorted(self.sampled, at), len(self.sampled) - 1)
            found = self.sampled[k] == at
            out[live[found]] = self.positions[k[found]] + steps
            live, at = live[~found], at[~found]
            if len(live):
                c = self.tree.symbol(at)
                at = self.starts[c] + self.tree.rank(c, at)
            steps += 1
        return out


def _collapsed(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with each run of 0, and each border between documents, as one 0; and the word of each place (-1 for a border)."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(numbers)) + doc + 1  # a 0 ahead of each document
    line = np.zeros(len(numbers) + len(counts), dtype=np.int64)
    word = np.full(len(line), -1, dtype=np.int64)
    line[places], word[places] = numbers, np.arange(len(numbers))
    keep = np.ones(len(line), dtype=bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
    return line[keep], word[keep]


def find_phrases(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in the batch."""
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not len(phrases.keys):
        return none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    numbers = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0)
    line, word = _collapsed(numbers, words.first)
    index = FMIndex(line + 1)  # numbers of the index begin at 1; the gap is 1, the end 0
    low, high = index.search(np.where(phrases.reversed >= 0, phrases.reversed + 1, -1))
    counts = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    start = word[index.locate(rows)]
    real = np.array([phrases.keys[p] == b" ".join(words.text(x, x) for x in range(s, s + phrases.lengths[p])) for s, p in zip(start, phrase, strict=True)], dtype=bool)
    return start[real], phrase[real]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items (as name and text) in blocks of at most limit bytes or one item; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null").toLocalIterator():
        own = len(row.text.encode())
        if block and size + own > limit:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += own
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (text and any other columns) with n_words, spans (merged runs of hit words, from and up to, as word numbers) and items (item_ids with an occurrence, sorted as strings)."""
    spans_type = T.ArrayType(T.ArrayType(T.LongType(), False), False)
    out = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast(spans_type)).withColumn("items", F.array().cast("array<string>"))
    schema = out.schema
    shared = None
    for block in chain(_blocks(benchmark, PHRASE_BYTES), [[]]):
        if shared is not None and not block:
            break
        if shared is not None:  # what the last block found is kept before the next is sent
            out = written(out, "marked")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most PHRASE_BYTES

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for batch in (x for whole in batches for x in pieces(whole, ["text"], SHARD_BYTES)):
                words = Words(*buffers(batch.column("text")), NOT_ALNUM)
                start, phrase = find_phrases(words, phrases)
                doc = np.searchsorted(words.first, start, side="right") - 1
                hits: dict[int, tuple[list, set]] = {}
                for d, s, p in zip(doc.tolist(), start.tolist(), phrase.tolist(), strict=True):
                    runs, items = hits.setdefault(d, ([], set()))
                    a = s - int(words.first[d])
                    runs.append([a, a + int(phrases.lengths[p])])
                    items.update(phrases.items[i] for i in phrases.owners[p])
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for d, (runs, names) in hits.items():
                    spans[d] = merged(spans[d] + runs)
                    items[d] = sorted(names.union(items[d]), key=str.encode)
                made = {"n_words": pa.array(np.diff(words.first), pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made.get(name, batch.column(name)) for name in batch.schema.names], names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
    return out


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def judged(marked: DataFrame) -> DataFrame:
    """marked with n_hit (words inside spans) and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])
    return marked.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the others as they are."""
    inner, back = apart(docs, "text")
    return back(judged(mark(inner, benchmark)).where("not contaminated"))


def removed_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with their hit spans cut out of the text (from the first to the last byte of each span)."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, ["text"], SHARD_BYTES)):
            raw, offsets = buffers(batch.column("text"))
            words, texts = Words(raw, offsets, NOT_ALNUM), batch.column("text").to_pylist()
            for d, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    data, base = raw[offsets[d] : offsets[d + 1]].tobytes(), words.first[d]
                    ends = [(int(words.start[base + a] - offsets[d]), int(words.end[base + b - 1] - offsets[d])) for a, b in spans]
                    kept = [0, *[x for pair in ends for x in pair], len(data)]
                    texts[d] = b"".join(data[kept[k] : kept[k + 1]] for k in range(0, len(kept), 2)).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    inner, back = apart(docs, "text")
    names = inner.columns
    return back(mark(inner, benchmark).mapInArrow(cut_out, inner.schema))

