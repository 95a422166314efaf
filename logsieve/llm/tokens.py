"""Token ids of whole texts by the tokenizers library, with a memo of words.

The tokenizer's pre-tokenizer drops white space and none of its pieces spans it, so a text's ids are those of
its white-space-separated words, one after the other (a tokenizer that keeps white space is refused). Texts
repeat words so much that a batch's distinct words are few: Arrow splits a batch, numbers its words and parts
them, the library encodes the parts that the task has not met, and numpy lays the ids out in the texts' order.
A word of Latin letters and a tail of punctuation is two pieces to the pre-tokenizer, so its letters (in lower
case, as the normalizer makes them) and its tail are looked up apart. What a task met is kept as Arrow strings
and numbers. This memo is emptied at its bound, which changes no result, and a task gives it back when it ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logsieve.llm.common import release

#: Bytes of each of a task's two memos, as reckoned by ``_ENTRY`` for each word and the word's and its ids' own.
MEMO_BYTES = 16 << 20
#: Words in each memo.
MEMO_WORDS = 200_000
_ENTRY = 40
#: Longer words are encoded whenever they are met.
LONG_WORD = 64
#: Bytes of text whose ids are laid out at a time.
SLICE = 1 << 20
#: Strings that the library encodes at a time; what it returns for one takes some hundred bytes for each id.
STRINGS = 64
#: Words whose ids are put in place at a time.
PLACES = 32_768
#: Letters whose lower case is one letter and which normalization leaves alone, and marks that no contraction has.
_PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?#$%&*]*)$"
_JOIN = 64


class _Memo:
    """Distinct words, their ids one word after the other, and the number of ids of each; without a Python object for a word."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def held(self) -> int:
        return self.words.nbytes + self.ids.nbytes + _ENTRY * len(self.words)

    def add(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        """Takes new words, but not long ones."""
        keep = pc.less_equal(pc.utf8_length(words), LONG_WORD)
        if not pc.all(keep).as_py():
            short = np.array(keep.to_pylist(), bool)
            words, ids, n = words.filter(keep), ids[np.repeat(short, n)], n[short]
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to ids; one for each worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True
        self.forget()
        if len(self.tokenizer.encode(" a  b\n", add_special_tokens=False).ids) != len(self._each(["a", "b"])[0]):
            raise ValueError("this tokenizer keeps white space, so that a text's ids are not those of its words")

    def forget(self) -> None:
        """Empties the memos: of words of plain letters, and of others."""
        self.plain, self.others = _Memo(), _Memo()

    def _each(self, words: list[str], at_once: int = STRINGS * _JOIN) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), at_once):
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words[i : i + at_once], add_special_tokens=False)]
            ids.append(np.concatenate(found))
            n.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(ids), np.concatenate(n)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters: many in one string, told apart by the ids that end a word."""
        if not self.suffix or not words:
            return self._each(words)
        ids, _ = self._each([" ".join(words[i : i + _JOIN]) for i in range(0, len(words), _JOIN)], STRINGS)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _known(self, words: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and the number of ids of each."""
        memo = self.plain if plain else self.others
        if memo.held() > MEMO_BYTES or len(memo.words) > MEMO_WORDS:
            memo.clear()
        words = words.cast(pa.large_string())
        at = pc.fill_null(pc.index_in(words, value_set=memo.words), -1).to_numpy().astype(np.int64)
        unmet = at < 0
        ids, n = memo.ids, memo.n
        if unmet.any():
            new = words.filter(pa.array(unmet))
            found = self._plain(new.to_pylist()) if plain else self._each(new.to_pylist())
            at[unmet] = len(n) + np.arange(len(new))
            ids, n = np.concatenate([ids, found[0]]), np.concatenate([n, found[1]])
            memo.add(new, *found)
        return ids[_spread((np.cumsum(n) - n)[at], n[at])], n[at]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and the number of ids of each."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        rest = words.filter(pc.invert(parts.is_valid()))
        letters = pc.utf8_lower(parts.field("letters")).filter(parts.is_valid()).dictionary_encode()
        tails = parts.field("tail").filter(parts.is_valid()).dictionary_encode()
        pools = [self._known(letters.dictionary, True), self._known(tails.dictionary, False), self._known(rest, False)]
        # each word's first and second part as numbers into the pools, one pool after the other
        number = np.cumsum([0, *(len(n) for _, n in pools)])
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1)
        first[plain], second[plain] = letters.indices.to_numpy(), number[1] + tails.indices.to_numpy()
        first[~plain] = number[2] + np.arange(len(rest))
        pool, n = np.concatenate([p for p, _ in pools]), np.concatenate([n for _, n in pools])
        starts = np.cumsum(n) - n
        both = np.stack([first, second], 1).ravel()
        both = both[both >= 0]
        out = pool[_spread(starts[both], n[both])]
        own = n[first] if len(words) else np.zeros(0, np.int64)
        own = own + np.where(second >= 0, n[second], 0) if len(n) else own
        return out, own

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts a slice at a time, so that no more than a slice's ids are held: its first text, all its ids, and the number of ids of each text. Null counts as empty."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(texts):
            done = sizes[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, done + SLICE)))
            yield i, *self._slice(pc.fill_null(texts.slice(i, j - i).cast(pa.large_string()), ""))
            release()
            i = j

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array of uint32, and the number of ids of each text. Null counts as empty."""
        found = list(self.slices(texts))
        return np.concatenate([np.zeros(0, "<u4"), *(x for _, x, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in found)])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        numbered = split.flatten().dictionary_encode()
        which = numbered.indices.to_numpy()
        pool, lengths = self.words(numbered.dictionary)
        starts = np.cumsum(lengths) - lengths
        each = lengths[which] if len(which) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        out = np.empty(int(total[-1]), "<u4")
        for a in range(0, len(which), PLACES):
            w, n = which[a : a + PLACES], each[a : a + PLACES]
            at, end = int(total[a]), int(total[min(a + PLACES, len(which))])
            out[at:end] = pool[_spread(starts[w], n)]
        return out, np.diff(total[bounds])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one after the other."""
    end = np.cumsum(lengths)
    return np.repeat(starts - (end - lengths), lengths) + np.arange(end[-1] if len(end) else 0)


_encoders: dict[str, WordEncoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for the file at ``path`` (loaded once for a worker), its memo empty again behind it."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
        release()
    found = _encoders[path]
    try:
        yield found
    finally:
        found.forget()
        release()
