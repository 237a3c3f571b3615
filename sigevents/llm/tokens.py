"""Subword ids from a public tokenizer file, with a bounded memory of words already seen.

A byte-level BPE cuts a text at every single space that stands between two characters that are not
white space, so such pieces can be encoded once and looked up afterwards; the ids are those of the
whole text. Texts with other white space around a space are encoded whole, and so are texts that hold
the string of an added token, which the library turns into that token's id.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from sigevents.llm.common import kept

#: Characters that never join a letter in one piece; the apostrophe does (contractions).
_TAIL = ".,;:!?%*$#&()[]{}\"/\\-+=_<>|~^@"
#: Letters whatever the version of Unicode; other pieces are looked at one by one.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
has_space = re.compile(r"\s").search


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that begin at ``start`` and have ``size`` items, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat((start - (ends - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class Memory:
    """Words seen and their ids, in flat arrays."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))

    def keep(self, words: pa.Array) -> None:
        """Forget all other words."""
        held = pc.is_in(self.words, value_set=words)
        stay = held.to_numpy(zero_copy_only=False)
        self.words, self.flat, self.size = self.words.filter(held), ragged(self.flat, self.start[stay], self.size[stay]), self.size[stay]
        self.start = np.cumsum(self.size) - self.size

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of words, -1 for unknown ones."""
        return np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1))


class WordEncoder:
    """Encodes texts by their pieces. ``limit`` bounds the words remembered.

    A piece is cut at line feeds into parts, and a part of letters with punctuation after them into word
    and tail; words, tails and all other parts are looked up. Ids are unsigned, 32-bit, little-endian.
    """

    def __init__(self, name: str, limit: int = 400_000):
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.n_bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)])
        self.limit = limit
        self.newline = self._ids("\n")
        self.after, self.bare = Memory(), Memory()  # words after a space; at the start of a text or line, and tails

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, words: list[str], sep: str) -> list[bytes]:
        """Encode many words in one call and cut the ids at the words' byte lengths.

        A separating space starts the next word's ids; a separating newline is an id of its own.
        """
        lead, gap = (sep, 0) if sep == " " else ("", len(self.newline))
        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([lead + sep.join(part) + sep * (not lead)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = (4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[b : e - gap] for b, e in zip([0, *cuts], cuts, strict=False)]
        return out

    def _places(self, memory: Memory, words: pa.Array) -> np.ndarray:
        """Places in a memory of distinct words, which are learned if they are new."""
        places = memory.find(words)
        new = places < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            spaced = memory is self.after
            strings = fresh.to_pylist()
            plain = [w for w in strings if w and not has_space(w)]
            learned = iter(self._learned(plain, " " if spaced else "\n"))
            ids = [b"" if not w else self._ids(" " + w if spaced else w) if has_space(w) else next(learned) for w in strings]
            places[new] = len(memory.size) + np.arange(len(ids))
            memory.add(fresh, ids)
        return places

    def _pieces(self, pieces: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, each one's number of ids, and which ones have to be encoded with their text; the first ``spaced`` follow a space."""
        lines = pc.split_pattern(pieces, "\n")
        first = lines.offsets.to_numpy()[:-1].astype(np.int64) - lines.offsets[0].as_py()
        coded = lines.flatten().dictionary_encode()
        part, parts = coded.indices.to_numpy(), coded.dictionary
        words = pc.utf8_rtrim(parts, _TAIL)
        uncut, bad = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
        odd = np.flatnonzero(~pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False))
        for i, k in zip(odd.tolist(), parts.take(pa.array(odd)).to_pylist(), strict=True):
            if not k.rstrip(_TAIL).isalpha():
                uncut[i], bad[i] = True, not k or k[0].isspace() or k[-1].isspace()
        words = pc.if_else(pa.array(uncut), parts, words)
        # tails are what words leave of their parts; a part without one has the empty tail
        offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset)
        begin = offsets[:-1] + pc.binary_length(words).to_numpy()
        size = offsets[1:] - begin
        raw = ragged(np.frombuffer(parts.buffers()[2] or b"", np.uint8), begin, size)
        tails = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        leads = np.zeros(len(part), bool)
        leads[first[:spaced]] = True
        wanted = []
        for memory, at in ((self.after, leads), (self.bare, ~leads)):
            used = np.zeros(len(parts), bool)
            used[part[at]] = True
            used &= ~bad
            wanted.append((memory, at, used, words.filter(pa.array(used)).dictionary_encode()))
        if len(self.after.size) + len(self.bare.size) > self.limit:  # keep what is wanted now
            for memory, _, _, some in wanted:
                memory.keep(some.dictionary)
        # of each part three places: a line feed or nothing, word, tail
        nothing, feed = self._places(self.bare, pa.array(["", "\n"])).tolist()
        places = np.empty((len(part), 3), np.int64)
        places[:, 0] = feed
        places[first, 0] = nothing
        places[:, 2] = self._places(self.bare, tails.dictionary)[tails.indices.to_numpy()][part]
        for memory, at, used, some in wanted:
            found = np.full(len(parts), nothing)
            found[used] = self._places(memory, some.dictionary)[some.indices.to_numpy()]
            places[at, 1] = found[part[at]]
        shift = np.where(leads & ~bad[part], 0, len(self.after.size))
        places[:, 1] += shift
        places[:, ::2] += len(self.after.size)
        size = np.append(self.after.size, self.bare.size)[places]
        start = np.append(self.after.start, len(self.after.flat) + self.bare.start)[places]
        ids = ragged(np.append(self.after.flat, self.bare.flat), start.ravel(), size.ravel())
        return ids, np.add.reduceat(size.sum(1), first), np.logical_or.reduceat(bad[part], first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each one's number of ids, as the library gives them for it with ``add_special_tokens=False``."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern(texts, " ")
        begin = words.offsets.to_numpy()[:-1].astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        heads = pieces.take(pa.array(which[begin]))
        # ids of pieces after a space, of pieces at the start of texts, and of texts encoded whole
        flat, size, uncut = self._pieces(pa.concat_arrays([pieces, heads]), len(pieces))
        inner = uncut[which]
        inner[begin] = uncut[len(pieces) :] & (pc.binary_length(heads).to_numpy() > 0)
        whole |= np.logical_or.reduceat(inner, begin)
        at = np.flatnonzero(whole)
        more = [self._ids(texts[i].as_py()) for i in at.tolist()]
        flat = np.append(flat, np.frombuffer(b"".join(more), "<u4"))
        size = np.append(size, np.fromiter(map(len, more), np.int64, len(more)) // 4)
        entry = which.astype(np.int64)
        entry[begin] = len(pieces) + np.arange(len(begin))
        n = size[entry]
        if len(at):
            n[np.repeat(whole, np.diff(np.append(begin, len(which))))] = 0
            entry[begin[at]] = len(pieces) + len(heads) + np.arange(len(at))
            n[begin[at]] = size[entry[begin[at]]]
        return ragged(flat, (np.cumsum(size) - size)[entry], n), np.add.reduceat(n, begin)


#: The kind of tasks that keep encoders.
KEPT = "word encoders"


def encoder(name: str, limit: int = 400_000) -> WordEncoder:
    """One encoder per Python worker, kept from task to task of those that ``tidied`` knows to keep ``KEPT``."""
    held = kept(KEPT)
    if (name, limit) not in held:
        held[name, limit] = WordEncoder(name, limit)
    return held[name, limit]
