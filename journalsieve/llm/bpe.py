"""BPE encoding and decoding by a prefix-sharing trie.

The BPE encoding of a prefix is fixed by its last token: it is the encoding of the prefix before that
token, plus the token.  So the state of a trie node is just (last token, where it starts), and words
that share a prefix share the states on their path.  A token may end a prefix if it follows the last
token of the shorter prefix *compatibly*: merging the two tokens' symbols together gives exactly
these two tokens back.  Compatibility depends on the pair alone and is remembered.

The distinct new words of a portion of texts, sorted, are the trie in depth-first order; a stack holds
the states of the current path, and each word only computes the nodes below the prefix it shares with
its predecessor.  Everything runs map-side, without a shuffle, so hot keys and lost executors cost
nothing but a repeated task.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from journalsieve.llm.common import in_portions, text_portions

END = "</w>"
#: Words and pieces whose ids a worker keeps, and token pairs it knows; a full table is emptied.
KEPT_WORDS, KEPT_PAIRS = 400_000, 1_000_000
#: Characters split at a time: the more, the more new words share one walk.
PORTION = 4 << 20

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# letters, numbers and white space below U+0250, where normal form C changes nothing
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]"
                    "|[^\t-\r \x85\xa0a-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
# str.split() takes four control characters for white space that are none here
_NOT_PLAIN = re.compile("[^\x00-ɏ]|[\x1c-\x1f]")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next sign from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixTrieEncoder:
    """Encoder of one vocabulary file (BPE with word ends, byte-level symbols)."""

    def __init__(self, path: str, kept: int = KEPT_WORDS, portion: int = PORTION):
        self.kept, self.portion = kept, portion
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.token_of = {str(i): t for i, t in names.items()}
        self.text_of = {i: str(i) for i in names}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._path = path

        parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of the merge
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            parts.setdefault(whole, (left, right, rank))
            self.merged.setdefault((left, right), rank)
        base = set(_byte_characters().values())
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            if i in parts or token in base or token.removesuffix(END) in base:
                if token.endswith(END):
                    self.final[token.removesuffix(END)] = i
                else:
                    self.inner[token] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        never = len(self.merged)
        self.right_edge, self.left_edge = {}, {}
        for i in names:
            self.right_edge[i] = self._edge(i, parts, 1, never)
            self.left_edge[i] = self._edge(i, parts, 0, never)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.byte_signs = {b: ord(c) for b, c in _byte_characters().items()}

    @staticmethod
    def _edge(token: int, parts: dict, side: int, never: int) -> list[tuple[int, int]]:
        """From the outermost symbol up: (part at the token's edge, rank of the merge that takes it in)."""
        edge, until = [], never
        while token in parts:
            edge.append((token, until))
            until = parts[token][2]
            token = parts[token][side]
        edge.append((token, until))
        return edge[::-1]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the symbols of both tokens, merged together, give the two tokens again.

        Both edges grow in the order of their merges; a merge over the border wins if it ranks before
        what would take in either part (the leftmost first among equal ranks).
        """
        left, right = self.right_edge[first], self.left_edge[second]
        i = j = 0
        answer = True
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.merged.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                answer = False
                break
            at_top = (i + 1 == len(left), j + 1 == len(right))
            if all(at_top):
                break
            if at_top[1] or not at_top[0] and x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[first << 20 | second] = answer
        return answer

    def learn(self, words: Iterable[str]) -> dict[str, str]:
        """Encode distinct words by one depth-first walk through their trie."""
        signs, longest, pairs = self.byte_signs, self.longest, self.pairs
        ids_of, learnt = self.text_of, {}
        spelled = sorted([(w.encode().decode("latin-1").translate(signs), w) for w in words])
        last, starts, path = [0], [0], ""
        for spelling, word in spelled:
            size = len(spelling)
            shared = min(len(last), size) - 1
            while path[:shared] != spelling[:shared]:
                shared -= 1
            del last[shared + 1:], starts[shared + 1:]
            for end in range(shared + 1, size + 1):
                token_at = (self.inner if end < size else self.final).get
                # the last token often starts where that of the shorter prefix does; only one start fits
                for start in (starts[-1], *range(max(0, end - longest), end)):
                    token = token_at(spelling[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    fits = pairs.get(last[start] << 20 | token)
                    if fits or fits is None and self.compatible(last[start], token):
                        break
                else:
                    raise ValueError(f"no token ends {spelling[:end]!r}")
                if end < size:
                    last.append(token)
                    starts.append(start)
            path = spelling
            ids = [token]
            while start:
                ids.append(last[start])
                start = starts[start]
            learnt[word] = " ".join([ids_of[i] for i in reversed(ids)])
        return learnt

    @functools.cached_property
    def _library(self):
        import regex
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path).normalizer.normalize_str, regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall

    def pieces_of(self, text: str) -> list[str]:
        """What white space separates; no word reaches across it."""
        if not _NOT_PLAIN.search(text):
            return text.split()
        return [p for p in self._library[0](text).split(" ") if p]

    def words_of(self, piece: str) -> list[str]:
        """Lower-case words; outside the Latin blocks by the library's normaliser."""
        if piece.isascii():
            return _ASCII.findall(piece.lower())
        if not _NOT_PLAIN.search(piece):
            return _LATIN.findall(piece.lower())
        normal, findall = self._library
        return findall(normal(piece))

    def _learn_pieces(self, fresh: set[str]) -> None:
        words_of = {p: self.words_of(p) for p in fresh}
        new_words = set().union(*words_of.values())
        known = {w: self.words[w] for w in new_words.intersection(self.words)}
        known.update(self.learn(new_words.difference(known)))
        if len(self.words) > self.kept:
            self.words.clear()
        self.words.update(known)
        look = known.__getitem__
        self.pieces.update((p, " ".join(map(look, words))) for p, words in words_of.items())

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids of each text, joined by spaces."""
        for portion in in_portions(texts, self.portion):
            split = []  # of each text: special tokens as their ids, the rest as lists of pieces
            fresh: set[str] = set()
            for i in portion:
                marked = self.split_special.split(texts[i]) if "<|" in texts[i] else [texts[i]]
                split.append([self.special.get(m) or self.pieces_of(m) for m in marked])
                fresh.update(*[p for p in split[-1] if isinstance(p, list)])
            new = fresh.difference(self.pieces)
            if len(self.pieces) + len(new) > self.kept:
                self.pieces.clear()
                new = fresh
            self._learn_pieces(new)
            look = self.pieces.__getitem__
            for parts in split:
                ids = [" ".join(map(look, p)) if isinstance(p, list) else str(p) for p in parts]
                yield " ".join(filter(None, ids))

    def decode(self, ids: str) -> str:
        """The tokens of space-joined ids; this vocabulary has no decoder, so a space joins them."""
        return " ".join(map(self.token_of.__getitem__, ids.split(" "))) if ids else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str, kept: int = KEPT_WORDS, portion: int = PORTION) -> PrefixTrieEncoder:
    return PrefixTrieEncoder(path, kept, portion)


_OUTPUTS = {
    "n_tokens": ("long", pa.int64(), lambda ids, text: ids.count(" ") + 1 if ids else 0),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, text: np.fromstring(ids, np.int32, sep=" ")),
    "decoded": ("string", pa.string(), lambda ids, text: text()),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids.encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(),
                       lambda ids, text: hashlib.sha256(text().encode()).hexdigest()),
}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = (),
                  kept: int = KEPT_WORDS, portion: int = PORTION) -> DataFrame:
    """Encode every whole text with the vocabulary file at ``path`` and decode the ids again.

    ``outputs`` chooses among n_tokens, ids, decoded, ids_sha256, decoded_sha256.  A null text counts as
    empty (no tokens, empty strings); null ids and repeated rows pass through; an empty table gives an
    empty table; of the other columns only those in ``keep`` pass through.  ``kept`` words a worker remembers and
    ``portion`` characters at a time trade memory for time; the results do not depend on them.
    """
    chosen = {name: _OUTPUTS[name] for name in outputs}
    passed = [id_col, *[k for k in keep if k not in (id_col, *chosen)]]
    source = docs.select(docs[text_col].cast("string").alias("__text"), *[docs[c] for c in passed])
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, kept, portion)
        for batch in batches:
            for start, texts in text_portions(batch.column(0), portion):
                columns: list[list] = [[] for _ in chosen]
                for ids in coder.encode(texts):
                    text = functools.cache(functools.partial(coder.decode, ids))
                    for column, (_, _, make) in zip(columns, chosen.values()):
                        column.append(make(ids, text))
                own = batch.slice(start, len(texts)).columns[1:]
                yield pa.RecordBatch.from_arrays(
                    [*own, *[pa.array(c, t) for c, (_, t, _) in zip(columns, chosen.values())]],
                    names=[*passed, *chosen])

    return source.mapInArrow(run, ", ".join(
        [*types, *[f"{n} {t}" for n, (t, _, _) in chosen.items()]]))
