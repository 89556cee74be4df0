"""Language-model scoring with a hierarchical Pitman-Yor model.

A text is its words, each closed by a space, and an end sign; the model predicts it byte by byte, so that
unseen words have a probability as well.  Every context of up to ``order - 1`` bytes, reaching back into
earlier words, is a restaurant; its parent is the context without the farthest byte, and contexts that
end alike share it.  A customer of a restaurant is a byte seen after the context, a table is a draw from
the parent, where it is a customer.

Gibbs sampling seats the customers again in rounds, given the tables of the others and the parent's
predictions; the predictive probabilities of the rounds are averaged.  All customers of one byte in one
restaurant are alike, so their seating is one number, drawn in growing steps for frequent bytes, and the
bytes of a restaurant are seated side by side, given each other's tables of the round before and the
parent's predictions with their own tables in it.  Against one-customer-at-a-time Gibbs a small corpus
shows chances 4.8 % off on average and 21 % at most (``tests/llm/test_pitman_yor.py``).

Contexts that share their last three bytes are seated in one partition with all their descendants, as
many partitions as the data need.  What lies above, at most 256^3 sequences whatever the corpus, is
seated in one task.

Texts are dealt into blocks of bounded size.  Each block lists its distinct words (for the additive base
score) and sequences with their training counts once, in packed lists by shard of the model.  The lists
give the model its counts, and later ask it for what the block needs; a block has at most ``shards`` of
them, so their number grows with the corpus, not with its square.  Shards and blocks are streamed: a task
holds one shard's or one block's part of the model, never a shard's lists or a block's texts together.
No table of the corpus is broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.llm.common import text_portions
from journalsieve.workspace import settle

END = b"\n"
#: Bytes of the sequences whose number the alphabet bounds.
UPPER = 3
#: Counted sequences a task holds before it sums equal ones again.
MERGED = 1_000_000
#: Sequences differ mostly in bytes that are far from even; a prime spreads them over the shards.
PRIME = 1_000_003


@dataclass(frozen=True)
class Settings:
    """Bytes of a sequence (7 at most), discount and strength, Gibbs rounds and those before averaging, sizes,
    seed.  ``shards`` bounds the lists of a block; a shard holds that share of the distinct sequences."""

    order: int = 6
    discount: float = 0.7
    strength: float = 1.0
    rounds: int = 5
    burn_in: int = 2
    passes: int = 2  # between the levels above and below
    block_bytes: int = 32 << 20
    shards: int = 1024
    partition_rows: int = 500_000
    seed: int = 0


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def sequences(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` bytes at every byte of each text, as integers; end signs stand before a text.

    Also returns where each text's sequences begin.
    """
    lead = END * (order - 1)
    spelled = [b" ".join([*words, END]) if words else END for words in texts]
    data = np.frombuffer(lead + lead.join(spelled), np.uint8)
    whole, length = data.astype(np.int64), 1
    for bit in f"{order:b}"[1:]:  # as in raising to a power: twice as long, and one byte more
        whole, length = (whole[:-length] << 8 * length) | whole[length:], 2 * length
        if bit == "1":
            whole, length = (whole[:-1] << 8) | data[length:], length + 1
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    ends = np.cumsum(sizes + order - 1)
    inside = np.ones(len(whole) + order - 1, bool)
    for k in range(order - 1):
        inside[ends - 1 - k] = False
    return whole[inside[:len(whole)]], np.cumsum(sizes) - sizes


# --- seating ------------------------------------------------------------------------------------------

def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, settings: Settings,
         draw: np.random.Generator) -> np.ndarray:
    """Tables of each byte's customers, seated one after another given the other tables of the restaurant.

    A customer joins one of the byte's ``t`` tables in proportion to ``i - discount * t``, or opens one in
    proportion to the restaurant's pull times the parent's probability.  The first always opens one.  From
    ten customers on, a tenth of those seated are seated at once, at the same probability.
    """
    d, strength = settings.discount, settings.strength
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated = np.ones(len(at), np.int64)
    while len(at):
        t = tables[at]
        opening = (strength + d * (others[at] + t)) * base[at]
        chance = opening / (opening + seated - d * t)
        step = np.minimum(np.maximum(1, seated // 10), customers[at] - seated)
        tables[at] += draw.binomial(step, chance)
        seated += step
        more = seated < customers[at]
        at, seated = at[more], seated[more]
    return tables


def sample(codes: np.ndarray, counts: np.ndarray, high: int, low: int, base: np.ndarray, settings: Settings,
           seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gibbs rounds over the levels ``high`` to ``low`` of sorted distinct sequences.

    ``base`` has the parent's probability of each distinct sequence of length ``low - 1``, in order.
    Returns the averaged predictive probability of each of ``codes``, and the distinct sequences of
    length ``low`` with their averaged number of tables.
    """
    draw = np.random.default_rng([settings.seed, high, seed])
    levels, parents, rooms, sizes = {high: codes}, {}, {}, {}
    for k in range(high, low - 1, -1):
        short, parents[k] = np.unique(levels[k] & ((1 << 8 * (k - 1)) - 1), return_inverse=True)
        contexts, rooms[k] = np.unique(levels[k] >> 8, return_inverse=True)
        sizes[k] = len(contexts)
        levels[k - 1] = short
    customers, tables = {high: counts}, {}
    for k in range(high, low - 1, -1):
        tables[k] = np.minimum(customers[k], 1)
        customers[k - 1] = np.bincount(parents[k], tables[k], len(levels[k - 1])).astype(np.int64)
    total, low_tables, kept = np.zeros(len(codes)), np.zeros(len(levels[low])), 0
    for turn in range(settings.rounds):
        chance, in_room = {low - 1: base}, {}
        for k in range(low, high + 1):
            in_room[k] = np.bincount(rooms[k], tables[k], sizes[k])
            guests = np.bincount(rooms[k], customers[k], sizes[k])
            pull = settings.strength + settings.discount * in_room[k]
            chance[k] = ((customers[k] - settings.discount * tables[k] + pull[rooms[k]] * chance[k - 1][parents[k]])
                         / (settings.strength + guests[rooms[k]]))
        if turn >= settings.burn_in:
            total += chance[high]
            low_tables += tables[low]
            kept += 1
        for k in range(high, low - 1, -1):
            tables[k] = seat(customers[k], in_room[k][rooms[k]] - tables[k], chance[k - 1][parents[k]],
                             settings, draw)
            customers[k - 1] = np.bincount(parents[k], tables[k], len(levels[k - 1])).astype(np.int64)
    return total / kept, levels[low], low_tables / kept


# --- counting -----------------------------------------------------------------------------------------

def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)])


def _counted(codes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences and how often each comes with its mark set; the mark is sorted along as the last bit."""
    marked = np.sort((codes << 1) | trained)
    codes = marked >> 1
    first = _firsts(codes)
    return codes[first], np.add.reduceat(marked & 1, first) if len(first) else first


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([np.zeros(0, np.int64), *codes])
    order = np.argsort(found, kind="stable")  # what is sorted already is merged
    found, n = found[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
    first = _firsts(found)
    return found[first], np.add.reduceat(n, first) if len(first) else n


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64)


def _words_packed(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def _words_unpacked(packed: bytes) -> list[bytes]:
    return zlib.decompress(packed).split(b" ")


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the items by shard, and where each shard begins and the last ends."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


LISTS = "shard int, block int, words binary, seen binary, codes binary, counts binary"


def _list_blocks(order: int, shards: int):
    """(shard, block, words, seen, codes, counts): the distinct words and sequences of each block, and how
    often each occurs in its training texts, packed by shard; empty lists are left out."""
    names = [field.split()[0] for field in LISTS.split(", ")]

    def lists(block: int, words: Counter[bytes], found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        spelled = list(words)
        word_order, word_at = _by_shard(np.fromiter((zlib.crc32(w) % shards for w in spelled), np.int64, len(spelled)), shards)
        order_, at = _by_shard(found % PRIME % shards, shards)
        seen = np.fromiter(words.values(), np.int64, len(spelled))[word_order]
        spelled = [spelled[i] for i in word_order.tolist()]
        found, counts = found[order_], counts[order_]
        used = [k for k in range(shards) if word_at[k] < word_at[k + 1] or at[k] < at[k + 1]]
        cut = lambda values, ends, k: values[ends[k]:ends[k + 1]]
        return pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int32()),
            pa.array([_words_packed(cut(spelled, word_at, k)) if word_at[k] < word_at[k + 1] else None for k in used], pa.binary()),
            pa.array([_packed(cut(seen, word_at, k)) for k in used], pa.binary()),
            pa.array([_packed(np.diff(cut(found, at, k), prepend=0)) for k in used], pa.binary()),
            pa.array([_packed(cut(counts, at, k)) for k in used], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, codes, counts = None, Counter(), [], []
        for batch in batches:
            blocks, trains = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            ends = [*_firsts(blocks).tolist(), len(blocks)]
            for start, end in zip(ends, ends[1:]):
                if now not in (None, blocks[start]):
                    yield lists(now, words, *_summed(codes, counts))
                    words, codes, counts = Counter(), [], []
                now = blocks[start]
                for begin, texts in text_portions(batch.column(1).slice(start, end - start), 2 << 20):
                    split, trained = [words_of(t) for t in texts], trains[start + begin:start + begin + len(texts)]
                    found, starts = sequences(split, order)
                    per_text = np.diff(np.append(starts, len(found)))
                    found, n = _counted(found, np.repeat(trained, per_text))
                    codes.append(found)
                    counts.append(n)
                    if len(codes) > 1 and sum(map(len, codes)) > MERGED + len(codes[0]):
                        codes, counts = map(lambda x: [x], _summed(codes, counts))
                    words.update(chain.from_iterable(own for own, t in zip(split, trained) if t))
                    words[END] += int(trained.sum())
                    for own in (own for own, t in zip(split, trained) if not t):
                        words.update(dict.fromkeys(own, 0))
        if now is not None:
            yield lists(now, words, *_summed(codes, counts))

    return run


COUNTS = "key binary, code long, n long"


def _sum_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, code, n): the words and sequences of each shard with their counts, from the lists sorted by shard."""
    now, words, codes, counts = None, Counter(), [], []

    def sums() -> pa.RecordBatch:
        found, n = _summed(codes, counts)
        return pa.RecordBatch.from_arrays([
            pa.array([*words, *[None] * len(found)], pa.binary()),
            pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(found, pa.int64())]),
            pa.concat_arrays([pa.array(words.values(), pa.int64()), pa.array(n, pa.int64())])], names=["key", "code", "n"])

    for batch in batches:
        for shard, _, spelled, seen, found, n in zip(*[c.to_pylist() for c in batch.columns]):
            if now not in (None, shard):
                yield sums()
                words, codes, counts = Counter(), [], []
            now = shard
            if spelled is not None:
                words.update(dict(zip(_words_unpacked(spelled), _unpacked(seen).tolist())))
            codes.append(np.cumsum(_unpacked(found)))
            counts.append(_unpacked(n))
            if len(codes) > 1 and sum(map(len, codes)) > MERGED + len(codes[0]):
                codes, counts = map(lambda x: [x], _summed(codes, counts))
    if now is not None:
        yield sums()


# --- the model ----------------------------------------------------------------------------------------

def _gathered(batches: Iterator[pa.RecordBatch], *types: type) -> list[np.ndarray]:
    """The columns of a whole partition, which is of bounded size."""
    columns = [[np.zeros(0, t)] for t in types]
    for batch in batches:
        for column, values in zip(columns, batch.columns):
            column.append(values.to_numpy(zero_copy_only=False))
    return [np.concatenate(c) for c in columns]


def _cut(column: str, length: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def train(grams: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(code, chance): the averaged predictive probability of the last byte of each counted sequence.

    ``grams`` (code, n) is written; sequences of n = 0 are predicted only.
    """
    order = settings.order
    parts = max(1, -(-grams.count() // settings.partition_rows))
    upper = grams.select(_cut("code", UPPER).alias("upper")).distinct()
    seen = grams.filter("n > 0").select(_cut("code", UPPER + 1).alias("code")).distinct()
    tables = seen.groupBy(_cut("code", UPPER).alias("upper")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def sample_upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _gathered(batches, np.int64, np.float64)
        counts = np.rint(counts).astype(np.int64)
        sort = np.argsort(codes)
        if len(sort):
            chance, _, _ = sample(codes[sort], counts[sort], UPPER, 1, np.array([1 / 256]), settings, 0)
            yield pa.RecordBatch.from_arrays([pa.array(codes[sort]), pa.array(chance)], names=["upper", "base"])

    def sample_lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, base = _gathered(batches, np.int64, np.int64, np.float64)
        sort = np.argsort(codes)
        if not len(sort):
            return
        codes, counts, base = codes[sort], counts[sort], base[sort]
        _, first = np.unique(codes & ((1 << 8 * UPPER) - 1), return_index=True)
        chance, low, tables = sample(codes, counts, order, UPPER + 1, base[first], settings, int(codes[0]) + 1)
        for kind, code, value in ((order, codes, chance), (UPPER, low & ((1 << 8 * UPPER) - 1), tables)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), kind, np.int32)), pa.array(code), pa.array(value)],
                names=["kind", "code", "value"])

    result = None
    for _ in range(settings.passes):
        above = upper.join(tables, "upper", "left").select("upper", F.coalesce("n", F.lit(0.0)).alias("n"))
        base = settle(above.repartition(1).mapInArrow(sample_upper, "upper long, base double"), "lm-upper")
        joined = grams.withColumn("upper", _cut("code", UPPER)).join(base, "upper")
        room = F.shiftright(F.col("code"), 8).bitwiseAND(F.lit((1 << 24) - 1))  # the last three of the context
        dealt = joined.select("code", "n", "base").repartition(parts, room)
        result = settle(dealt.mapInArrow(sample_lower, "kind int, code long, value double"), "lm-lower")
        tables = result.filter(F.col("kind") == UPPER).groupBy(F.col("code").alias("upper")).agg(
            F.sum("value").alias("n"))
    return result.filter(F.col("kind") == order).select("code", F.col("value").alias("chance"))


# --- scoring ------------------------------------------------------------------------------------------

ANSWERS = "block int, words binary, counts binary, codes binary, chances binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, words, counts, codes, chances): what the model has for each list.

    Rows (shard, block, key, code, value, words, codes) are sorted by shard; those of the model come first,
    without a block.
    """
    now, parts, count_of, known, logs = None, [], {}, None, None
    for batch in batches:
        ends = [*_firsts(batch.column(0).to_numpy()).tolist(), batch.num_rows]
        for start, end in zip(ends, ends[1:]):
            part = batch.slice(start, end - start)
            if part.column(0)[0].as_py() != now:
                now, parts, known = part.column(0)[0].as_py(), [], None
            asked = part.column(1).is_valid()
            model = part.filter(pc.invert(asked)).select(["key", "code", "value"])
            if model.num_rows:
                parts.append(model)
            asking = part.filter(asked)
            if not asking.num_rows:
                continue
            if known is None:  # all of the shard's model has come
                whole, parts = pa.Table.from_batches(parts, model.schema), []
                named, grams = whole.filter(whole["key"].is_valid()), whole.filter(whole["code"].is_valid())
                count_of = dict(zip(named["key"].to_pylist(), named["value"].to_pylist()))
                sort = np.argsort(grams["code"].to_numpy())
                known, logs = grams["code"].to_numpy()[sort], grams["value"].to_numpy().astype(np.float32)[sort]
                del whole, named, grams
            for block, words, codes in zip(*[asking[n].to_pylist() for n in ("block", "words", "codes")]):
                counts = [] if words is None else [count_of.get(w, 0.0) for w in _words_unpacked(words)]
                chances = logs[np.searchsorted(known, np.cumsum(_unpacked(codes)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int32()), pa.array([words], pa.binary()),
                    pa.array([np.array(counts, float).tobytes()], pa.binary()), pa.array([codes], pa.binary()),
                    pa.array([chances.tobytes()], pa.binary())], names=["block", "words", "counts", "codes", "chances"])


#: An odd number whose powers spread the sequences over the slots of a table, and sequences placed at a time.
FACTOR, PLACED = 0x9E3779B97F4A7C15, 1 << 17


def _slots(codes: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return ((codes.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).view(np.int64)


def place_values(codes: np.ndarray, values: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Tables (factor, bits, values) of distinct ``codes``: each is alone in a slot of one of them.

    A slot that codes share holds no number; they go on to the next table, about a fifth each time.
    """
    tables, factor = [], FACTOR
    while len(codes) or not tables:
        bits = max(8, (4 * len(codes)).bit_length())
        at, order = _slots(codes, factor, bits), np.arange(len(codes), dtype=np.int32)
        last = np.zeros(1 << bits, np.int32)
        last[at] = order
        shared = np.zeros(1 << bits, bool)
        shared[at[last[at] != order]] = True
        alone, table = ~shared[at], np.full(1 << bits, np.nan, np.float32)
        table[at[alone]] = values[alone]
        tables.append((factor, bits, table))
        codes, values, factor = codes[~alone], values[~alone], factor * FACTOR % (1 << 64)
    return tables


def values_of(tables: list[tuple[int, int, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """The values of codes that were placed, repeats included."""
    found = np.empty(len(codes), np.float32)
    for start in range(0, len(codes), PLACED):
        part, own = codes[start:start + PLACED], found[start:start + PLACED]
        left = np.arange(len(part))
        for factor, bits, table in tables:
            own[left] = table[_slots(part[left], factor, bits)]
            left = left[np.isnan(own[left])]
    return found


def _score_block(order: int, whole: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores each text from the answers to its block; rows are sorted by block, the answers first."""
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def scored(part: pa.RecordBatch, of_word: dict[bytes, float], logs: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in names[2:]}
        for _, texts in text_portions(part["text"], 1 << 18):
            split = [words_of(t) for t in texts]
            found, starts = sequences(split, order)
            columns["score"].append(np.add.reduceat(values_of(logs, found).astype(float), starts))
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            counts = np.fromiter(map(of_word.__getitem__, chain.from_iterable(split)), float, sizes.sum())
            counts = np.insert(counts, np.cumsum(sizes), of_word[END])
            sizes += 1
            starts = np.cumsum(sizes) - sizes
            columns["n_tokens"].append(sizes)
            columns["n_known"].append(np.add.reduceat(counts > 0, starts, dtype=np.int64))
            columns["base_score"].append(np.add.reduceat(np.log10(counts + 1) - whole, starts))
        return pa.RecordBatch.from_arrays(
            [part["id"], part["held_out"], *[pa.array(np.concatenate(columns[n])) for n in names[2:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of_word, found, chances, logs = None, {}, [], [], None
        for batch in batches:
            ends = [*_firsts(batch["block"].to_numpy()).tolist(), batch.num_rows]
            for start, end in zip(ends, ends[1:]):
                part = batch.slice(start, end - start)
                if part["block"][0].as_py() != now:
                    now, of_word, found, chances, logs = part["block"][0].as_py(), {}, [], [], None
                answers = part["codes"].is_valid()
                held = part.filter(answers)
                for words, counts, own, logs_ in zip(*[held[n].to_pylist() for n in ("words", "counts", "codes", "chances")]):
                    if words is not None:
                        of_word.update(zip(_words_unpacked(words), np.frombuffer(counts).tolist()))
                    found.append(np.cumsum(_unpacked(own)))
                    chances.append(np.frombuffer(logs_, np.float32))
                texts = part.filter(pc.invert(answers))
                if texts.num_rows:
                    if logs is None:  # all answers to the block have come
                        logs, found, chances = place_values(np.concatenate(found), np.concatenate(chances)), [], []
                    yield scored(texts, of_word, logs)

    return run


def _beside(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Both tables' rows under the columns of both; what a table lacks is null."""
    return rows.unionByName(others, allowMissingColumns=True)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                settings: Settings = Settings()) -> DataFrame:
    """Trains on the rows that are not ``held_out`` and scores every row.

    Returns id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (additive unigram), score (log10 probability of the whole text under the model) and
    perplexity (per token).

    A null or empty text is the end alone.  Null ids pass through; repeated rows count and stay; extra
    columns are left out; an empty table gives an empty table.  Without training rows every probability
    is uniform.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // settings.block_bytes))
    shards = min(blocks, settings.shards)
    block = F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "text", ~F.col("held_out")).repartitionById(blocks, F.col("block"))
    lists = settle(dealt.sortWithinPartitions("block").mapInArrow(_list_blocks(settings.order, shards), LISTS), "lm-lists")
    counted = settle(lists.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
                     .mapInArrow(_sum_lists, COUNTS), "lm-counts")
    words = counted.filter(F.col("key").isNotNull() & (F.col("n") > 0))
    facts = words.agg(F.sum("n"), F.count(F.lit(1))).head()
    tokens, distinct = int(facts[0] or 0), int(facts[1])
    chances = train(counted.filter("code is not null").select("code", "n"), settings)
    known = words.select((F.crc32("key") % shards).cast("int").alias("shard"), "key",
                         F.lit(None).cast("long").alias("code"), F.col("n").cast("double").alias("value")).union(
        chances.select((F.col("code") % PRIME % shards).cast("int"), F.lit(None).cast("binary"), "code", F.log10("chance")))
    asked = _beside(known, lists.select("shard", "block", "words", "codes")).select(
        "shard", "block", "key", "code", "value", "words", "codes")
    answers = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", F.col("block").asc_nulls_first()).mapInArrow(_answer, ANSWERS)
    texts = rows.select(block.alias("block"), "id", "held_out", "text")
    whole = _beside(texts, answers).repartitionById(blocks, F.col("block")).sortWithinPartitions(
        "block", F.col("codes").isNull())
    id_type = rows.schema["id"].dataType.simpleString()
    scored = whole.mapInArrow(
        _score_block(settings.order, math.log10(tokens + distinct + 1)),
        f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
