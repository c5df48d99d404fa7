"""Token ids of whole texts, with a bounded memory of words.

The tokenizer in use drops white space and never joins anything across it, so a
text's ids are those of its words in a row. A chunk of texts is split and its words are numbered by Arrow kernels; each
distinct word is looked up once, and the ids are gathered by NumPy. A worker keeps the ids of short words that it has
seen, in two generations of bounded size: words that come up again move to the younger one. Only ASCII white space counts as a
border here; any other character stays inside its word for the library to treat.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
#: Letters up to U+00FF between punctuation other than the apostrophe, which the tokenizer splits off in any case.
_PIECES = r"^(?P<head>[!-&(-/:-@\[-`{-~]*)(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Bytes of text treated at once; the longest word that is kept; words in a generation.
CHUNK, LONGEST, MEMORY = 4 << 20, 32, 200_000


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ragged:
    """Rows of ids: ``flat`` with a start and a length for each row."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.flat, self.starts, self.lengths = flat, starts, lengths

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, in a row."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[rows] - (ends - lengths), lengths)
        at += np.arange(total)
        return self.flat[at]

    @classmethod
    def of(cls, parts: list[bytes]) -> Ragged:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        return cls(np.frombuffer(b"".join(parts), np.uint32), np.cumsum(lengths) - lengths, lengths)


class WordEncoder:
    """``encode_many(texts)``: the little-endian unsigned 32-bit ids of each text.

    ``path``: a ``tokenizers`` file whose normaliser and splitter treat each word
    between white space alone. ``literal_specials``: strings of special tokens are ordinary text.
    ``memory``: words in a generation; longer words than ``LONGEST`` bytes aren't kept, so the memory is bounded in bytes.
    """

    def __init__(self, path: str, literal_specials: bool = False, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        # the same model for lower-case words of plain letters, which need no normaliser and no pattern to split them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.memory, self.young, self.old = memory, {b"": b""}, {}
        self.special = [] if literal_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn_plain(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Ids of lower-case words of plain letters, from calls on many of them, cut where a word ends."""
        if not words:
            return []
        groups = [b" ".join(words[k : k + 400]).decode() for k in range(0, len(words), 400)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        cuts, raw = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist(), ids.tobytes()
        if len(cuts) != len(words) or cuts[-1] != len(raw):
            raise AssertionError("the tokenizer didn't end each word on its own")
        return list(map(raw.__getitem__, map(slice, [0, *cuts], cuts)))

    def _learn_cores(self, words: list[bytes]) -> list[bytes]:
        plain = [w for w in words if w.isascii()]
        rest = [w for w in words if not w.isascii()]
        of = dict(zip(plain, self._learn_plain(plain, self.ascii))) | dict(zip(rest, self._learn_plain(rest, self.plain)))
        return [of[w] for w in words]

    def _learn_others(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _known(self, words: list[bytes], learn) -> list[bytes]:
        """The ids of distinct words; ``learn`` gives those of words that aren't in the memory."""
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        again = {w: x for k in missing if (x := old.get(w := words[k])) is not None}
        new = [w for k in missing if (w := words[k]) not in again]
        if new:
            learnt = dict(zip(new, learn(new)))
            young.update(learnt if max(map(len, new)) <= LONGEST else {w: x for w, x in learnt.items() if len(w) <= LONGEST})
            again |= learnt
        young.update({w: x for w, x in again.items() if w in old})
        for k in missing:
            out[k] = again[words[k]]
        return out

    def _distinct(self, words: pa.Array) -> Ragged:
        """The ids of distinct words. Letters with punctuation around them are three pieces, which come up more often than the whole."""
        found = pc.extract_regex(words, _PIECES)
        simple = found.is_valid()
        for token in self.special:
            simple = pc.and_not(simple, pc.match_substring(words, token))
        found, other = found.filter(simple), words.filter(pc.invert(simple)).cast(pa.binary()).to_pylist()
        core, heads, tails = pc.utf8_lower(found.field("core")), found.field("head"), found.field("tail")
        numbered = [x.cast(pa.binary()).dictionary_encode() for x in (core, heads, tails)]
        parts: list[bytes] = [b""]
        places = np.zeros((len(words), 3), np.int64)
        rows = simple.to_numpy(zero_copy_only=False)
        for column, x, learn in zip((1, 0, 2), numbered, (self._learn_cores, self._learn_others, self._learn_others)):
            places[rows, column] = x.indices.to_numpy() + len(parts)
            parts += self._known(x.dictionary.to_pylist(), learn)
        places[~rows, 1] = np.arange(len(other)) + len(parts)
        parts += self._known(other, self._learn_others)
        pieces = Ragged.of(parts)
        lengths = pieces.lengths[places].sum(axis=1)
        return Ragged(pieces.take(places.ravel()), np.cumsum(lengths) - lengths, lengths)

    def chunks(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of each text, for chunks of about ``CHUNK`` bytes or one text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        first, size = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > CHUNK:
                yield self._chunk(texts.slice(first, k - first))
                first, size = k, 0
            size += n
        if first < len(texts):
            yield self._chunk(texts.slice(first))

    def encode_many(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [ids for chunk in self.chunks(array) for ids in chunk]

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = split.flatten().dictionary_encode()
        rows = numbered.indices.to_numpy()
        words = self._distinct(numbered.dictionary)
        n_words = pc.list_value_length(split).to_numpy().astype(np.int64)
        ids = np.cumsum(np.concatenate([[0], words.lengths[rows]]))
        cuts = (4 * ids[np.cumsum(np.concatenate([[0], n_words]))]).tolist()
        raw = words.take(rows).astype("<u4", copy=False).tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, literal_specials: bool = False) -> WordEncoder:
    """The worker's own encoder: Spark uses a Python worker again, and so its memory of words."""
    key = (path, literal_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, literal_specials)
    return _ENCODERS[key]


def encoded(batches: Iterator[pa.RecordBatch], path: str, literal_specials: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """For batches of identifier and text: chunks of identifiers and the ids of their texts."""
    for batch in batches:
        docs, at = batch.column(0).to_pylist(), 0
        for chunk in encoder(path, literal_specials).chunks(batch.column(1)):
            yield docs[at : at + len(chunk)], chunk
            at += len(chunk)
