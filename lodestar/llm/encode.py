"""Token ids of texts with a memo: a public tokenizer sees each different word once in a worker.

Both kinds of vocabulary cut a text before each space or line feed at least, so the ids of a text are those of its stretches
one after another. Where that does not hold (other white space in a row) the whole text goes to the tokenizer. Both also cut
between a letter or number and ASCII punctuation behind it, apostrophes aside, so a stretch is a word and what ends it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches and words that a worker remembers, or twice as many; UTF-8 bytes of texts whose stretches are looked up together.
MEMO, WORDS, TOGETHER = 300_000, 250_000, 2 << 20
#: New words that go to the tokenizer in one sequence, and sequences in one call.
SEQUENCE, CALL = 256, 32
_ENCODERS: dict[tuple[str, bool], Encoder] = {}
#: Two characters of white space in a row.
_TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
_WORD_AND_END = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.array(ids, "<u4").tobytes()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about TOGETHER bytes of text in the second column, or one longer text."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Encoder:
    """Ids as bytes. path: a vocabulary file, or the name of a public one, which each worker looks up. spaces: whether the vocabulary keeps white space (byte-level) or drops it (words with ends)."""

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(str(path))
        self.tokenizer.encode_special_tokens = True  # what looks like a special token in a text is text
        self.most = max(self.tokenizer.get_vocab().values())
        self.spaces, self.memo, self.words = spaces, Memo(MEMO), Memo(WORDS)

    def stretches(self, texts: pa.Array) -> pa.Array:
        if not self.spaces:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 "), "\x01")

    def parts(self, stretch: str) -> tuple[str, ...]:
        if not self.spaces and stretch.isascii():
            stretch = stretch.lower()  # as the vocabulary without spaces does itself
        m = None if stretch[-1:].isalnum() else _WORD_AND_END.fullmatch(stretch)
        return m.groups() if m else (stretch,)

    def tokenized(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids; each is encoded by itself."""
        sequences = [words[lo : lo + SEQUENCE] for lo in range(0, len(words), SEQUENCE)]
        for lo in range(0, len(sequences), CALL):
            some = sequences[lo : lo + CALL]
            for sequence, e in zip(some, self.tokenizer.encode_batch(some, is_pretokenized=True, add_special_tokens=False), strict=True):
                packed, counts = as_bytes(e.ids), np.bincount(np.array(e.word_ids, np.int64), minlength=len(sequence))
                ends = (4 * np.cumsum(counts)).tolist()
                yield from ((w, packed[begin:end]) for w, begin, end in zip(sequence, [0, *ends], ends))

    def learn(self, stretches: list[str]) -> None:
        parts = {s: self.parts(s) for s in stretches}
        new = self.words.missing(set().union(*parts.values()))
        ids = self.words.young
        ids.update(self.tokenized(new))
        self.memo.young.update((s, ids[p[0]] if len(p) == 1 else ids[p[0]] + ids[p[1]]) for s, p in parts.items())

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text; each different stretch is looked up once."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        whole = pc.and_(pc.or_(pc.match_substring(texts, "\x01"), pc.match_substring_regex(texts, _TWO_SPACES)), self.spaces)
        cut = self.stretches(pc.if_else(whole, "", texts))
        coded = cut.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(self.memo.missing(different))
        known = list(map(self.memo.young.__getitem__, different))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        place = np.concatenate([[0], np.cumsum(sizes[codes])])
        at = np.repeat(first[codes] - place[:-1], sizes[codes]) + np.arange(place[-1])
        ids = np.frombuffer(b"".join(known), "<u4")[at]
        ends = place[np.cumsum(pc.list_value_length(cut).to_numpy())].tolist()
        out = [ids[begin:end].tobytes() for begin, end in zip([0, *ends], ends)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = b"".join(x for _, x in self.tokenized([texts[int(i)].as_py()]))
        return out


class Memo:
    """What was seen of late: once so many are known the older half goes, but for those that are met again."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys, all different, that are not known; all others are young from now on."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                ids = old.get(k)
                if ids is None:
                    new.append(k)
                else:
                    young[k] = ids
        return new


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder for a vocabulary; it outlives a task."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]
