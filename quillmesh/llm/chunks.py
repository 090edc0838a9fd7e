"""Whole-text encoding with tokenizer files.

Texts are cut where the vocabulary's pre-tokenizer always cuts, so the ids of the parts in a row
are the ids of the whole text. Workers keep a bounded table of words they have met.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Of these characters (Latin-1 without controls and odd spaces) normal form and lower case are plain.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
#: The word splitter of the byte-level vocabularies.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of the splitter's white space (the 25 characters of the Unicode property) that are cut out of a text.
_LONG = 20_000
# runs of some length; each is walked once, whether it is long enough or not
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")
#: Longer words are not kept, so that a table of words has a bound in bytes too.
_KEPT_WORD = 48
_TO_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, with truncation and padding off."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters(word: str) -> str:
    """A word with each of its bytes as the letter that byte-level vocabularies write for it."""
    return word if word.isascii() and word.isprintable() and " " not in word else _TO_BYTES.pre_tokenize_str(word)[0][0]


class WordSplitter:
    """The words of a text under a vocabulary of lower-case words that drops white space."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.specials = sorted((str(x.content) for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")

    def is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def plain(self, text: str) -> list[str]:
        """Words of a plain text."""
        return _WORD.findall(text.lower())

    def other(self, text: str) -> list[tuple[str, bool]]:
        """(byte letters of a word or a special token, whether special) of any text, by the library."""
        out, at = [], 0
        for match in [*self.special.finditer(text), None]:
            normal = self.tokenizer.normalizer.normalize_str(text[at : match.start() if match else len(text)])
            out += [(word, False) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if match:
                out.append((match[0], True))
                at = match.end()
        return out


class _Table(dict):
    """Ids of words and of runs of words, made where one is asked for that isn't there."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, run: str) -> bytes:
        return self.make(run)


class WordEncoder:
    """Ids of whole texts by the library's BPE model, one call per distinct word.

    Words end at white space, which has no ids, so a plain text is looked up by what stands between white space, punctuation included;
    only runs that aren't known are cut into words.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        self.tokenizer = load(path)
        self.splitter, self.model, self.most = WordSplitter(self.tokenizer), self.tokenizer.model, most_words
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        self.known = _Table(self._run)

    def _keep(self, run: str, ids: bytes) -> bytes:
        if len(run) <= _KEPT_WORD:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return self._keep(word, b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(byte_letters(word))]))

    def _run(self, run: str) -> bytes:
        words = self.splitter.plain(run)
        if len(words) == 1:
            return self._word(run)
        known = self.known.get
        return self._keep(run, b"".join([self._word(word) if (ids := known(word)) is None else ids for word in words]))

    def encode(self, text: bytes) -> bytes:
        string = text.decode()
        if not self.splitter.is_plain(string):
            return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, self.type).tobytes()
        return b"".join(map(self.known.__getitem__, string.lower().split()))


class RankEncoder:
    """Ids of whole texts under a byte-level vocabulary, by its merge ranks.

    A byte-level file without a normaliser is a table of ranks, which is merged faster than by the
    file's own tokenizer and to the same ids; texts that hold its special tokens go to the latter.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None  # the file's own tokenizer is loaded where a text needs it
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}
        self.specials = [x.encode() for x in added]
        letters = {c: b for b in range(256) for c in [byte_letters_of(b)]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token.encode() not in self.specials}
        self.known = ranks
        self.ranks = tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.type = np.dtype("<u2" if max([*vocabulary.values(), *added.values()]) < 1 << 16 else "<u4")

    def encode(self, text: bytes) -> np.ndarray:
        string = text.decode()
        if any(s in text for s in self.specials):
            self.tokenizer = self.tokenizer or load(self.path)
            return np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, self.type)
        if len(text) < _LONG or not self._long_runs(string):
            return np.array(self.ranks.encode_ordinary(string), self.type)
        return np.array(self._with_long_runs(string), self.type)

    def _long_runs(self, string: str) -> list[re.Match]:
        return [run for run in _RUN.finditer(string) if run.end() - run.start() >= _LONG]

    def _with_long_runs(self, string: str) -> list[int]:
        """A word always ends before white space, and a run of it but for its last character is one word:
        so runs that are too long for the splitter are merged by themselves."""
        out, at = [], 0
        for run in self._long_runs(string):
            end = run.end() if run.end() == len(string) else run.end() - 1
            out += self.ranks.encode_ordinary(string[at : run.start()]) + self._merged(string[run.start() : end].encode())
            at = end
        return out + self.ranks.encode_ordinary(string[at:])

    def _merged(self, word: bytes) -> list[int]:
        """The ids of one long word: the lowest rank first, leftmost first, by a heap over a linked list."""
        known, parts = self.known, [word[i : i + 1] for i in range(len(word))]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [known[p] << 32 | i for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in known]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if not parts[i] or j < 0 or known.get(parts[i] + parts[j]) != rank:
                continue  # merged away since
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := known.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, rank << 32 | a)
        return [known[p] for p in parts if p]


def byte_letters_of(byte: int) -> str:
    """The letter for one byte: itself if it is visible, else the next free one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in visible else chr(0x100 + sum(b not in visible for b in range(byte)))
