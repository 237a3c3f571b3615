"""Scoring texts with a small causal self-attention model, and with a word baseline.

*Model.* A text, with A-Z in lower case, is written as the subword ids of a public tokenizer, and a
special id ends it. The ``IDS`` - 2 most frequent ids stand for themselves; all others are one id more,
and which of them is meant is told by their counts. One layer of causal self-attention over ids gives
the next one in two steps, its group and which of the group's ids it is, both by the network. The
network starts from the counts of pairs of ids over all training texts and is trained by Adam on all
windows of all training texts, each once, dealt to steps by a checksum so that every step has some from
every part of them; gradients are summed in Spark tasks. Texts are scored in windows of ``WINDOW`` ids that overlap: each id, and the
end of the text, is scored once, by the window that gives it the most context; windows of many texts
are one batch of masked attention.

*Baseline.* Add-one unigram over all words of all training texts, with the end of a text as one more
token. The most frequent words' counts are broadcast (``top_words`` of them at most); all others are
joined by shuffle, and as the frequent ones are out of it, no word is a hot key.

Null texts are empty: one token, the end. Rows that repeat are scored each, with the same result; a
null id is scored and counts as learned from. Without training rows every count is 0 and the model is
uniform. Any length of text is scored whole. Ids of equal count are taken in their order. Other columns
are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import id_crc32, keyed, stored, tidied
from sigevents.llm.tokens import ragged

WINDOW, STRIDE = 32, 24
WIDTH, GROUPS, MEMBERS = 32, 32, 32
IDS = GROUPS * MEMBERS
#: Numbers of a long array in one row.
LANES = 32
#: All rarer ids; the end (and start) of a text.
RARE, END = IDS - 2, IDS - 1
#: The end of a text among words; no word holds it.
END_WORD = "\n"

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(name: str) -> tiktoken.Encoding:
    """One tokenizer for each Python worker; no text has special tokens."""
    if name not in _encodings:
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


class Attention:
    """x = E + P; y = x + softmax(mask(QK'))V O; a group by y U + b, a member of it by y Ug + bg."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        square = (WIDTH, WIDTH)
        shapes = {"E": (IDS, WIDTH), "P": (WINDOW, WIDTH), "Q": square, "K": square, "V": square, "O": square, "U": (WIDTH, GROUPS), "b": (GROUPS,), "Ug": (GROUPS, WIDTH, MEMBERS), "bg": (GROUPS, MEMBERS)}
        self.w = {k: (r.normal(0, WIDTH**-0.5, s) * (k[0] != "b") * (0.1 if k in "PO" else 1)).astype(np.float32) for k, s in shapes.items()}
        self.group, self.member = np.divmod(np.arange(IDS), MEMBERS)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.ones = np.ones(WINDOW, np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """A work array that is used again, whatever it holds: new ones cost more than what is done in them."""
        size = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def ready(self) -> Attention:
        """With products of weights that scores and gradients need."""
        w = self.w
        self.rooms = {}
        self.qk = w["Q"] @ w["K"].T * np.float32(WIDTH**-0.5)
        self.vo = w["V"] @ w["O"]
        # scores of groups, then of the members of one group, from y and a one
        self.out = np.concatenate([np.broadcast_to(np.vstack([w["U"], w["b"]]), (GROUPS, WIDTH + 1, GROUPS)), np.concatenate([w["Ug"], w["bg"][:, None]], 1)], 2)
        # products with a matrix that lies transposed in memory cost thrice as much
        self.qk_t, self.vo_t, self.out_t = (np.ascontiguousarray(z.swapaxes(-1, -2)) for z in (self.qk, self.vo, self.out[:, :WIDTH]))
        # bounds of all scores, from all ids and places: small ones need no largest one taken off before exp()
        most = lambda z: float(np.abs(z).max())
        every = np.concatenate([w["U"], *w["Ug"]], 1)
        asked = sum(most(w[i] @ self.qk @ w[j].T) for i in "EP" for j in "EP")
        told = most(self.out[:, WIDTH]) + sum(most(w[k] @ every) + most(w[k] @ (self.vo @ every)) for k in "EP")
        self.steep = not max(asked, told) < 80
        return self

    def attend(self, c: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
        """x and x' of windows ``c``, with a row of -1 below; of their places from ``skip`` on xQK', the weights of attention, and the mean of x under them.

        xQK' and weights are the first and second halves of arrays with room for two matrices a window.
        """
        n, places = len(c), WINDOW - skip
        x = np.take(self.w["E"], c, axis=0, out=self.room("x", n, WINDOW, WIDTH), mode="clip")
        x += self.w["P"]
        x_t = self.room("x'", n, WIDTH + 1, WINDOW)
        x_t[:, :WIDTH], x_t[:, WIDTH] = x.transpose(0, 2, 1), -1
        q = np.matmul(x[:, skip:], self.qk, out=self.room("q", n, 2 * places, WIDTH + 1)[:, :places, :WIDTH])
        a = np.matmul(q, x_t[:, :WIDTH], out=self.room("a", n, 2 * places, WINDOW)[:, places:])
        if self.steep:
            a += self.mask[skip:]
            a -= a.max(2, keepdims=True)
            np.exp(a, out=a)
        else:
            np.exp(a, out=a)
            a *= self.seen[skip:]
        a *= 1 / (a @ self.ones)[:, :, None]
        return x, x_t, q, a, np.matmul(a, x, out=self.room("mean", n, places, WIDTH))

    def heads(self, x: np.ndarray, mean: np.ndarray, at: np.ndarray, t: np.ndarray) -> tuple:
        """For targets in order of their groups: that order, their places, the targets, y and a one, scores of groups and of members, each group's part."""
        g = self.group[t].astype(np.uint8)
        order = np.argsort(g, kind="stable")
        cuts = np.searchsorted(g[order], np.arange(GROUPS + 1)).tolist()
        parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        at, t = at[order], t[order]
        moved = np.matmul(mean, self.vo, out=self.room("moved", *mean.shape))
        moved += x
        y = self.room("y", len(at), WIDTH + 1)
        y[:, :WIDTH], y[:, WIDTH] = np.take(moved.reshape(-1, WIDTH), at, axis=0, out=self.room("some", len(at), WIDTH), mode="clip"), 1
        scores = self.room("scores", len(at), GROUPS + MEMBERS)
        for k, rows in parts:
            np.matmul(y[rows], self.out[k], out=scores[rows])
        if self.steep:
            halves = scores.reshape(-1, 2, MEMBERS)
            halves -= halves.max(2, keepdims=True)
        return order, at, t, y, scores, parts

    def summed(self, scores: np.ndarray) -> np.ndarray:
        """The sums of exp() of the scores of groups and of members, which takes their place."""
        np.exp(scores, out=scores)
        return (scores.reshape(-1, MEMBERS) @ self.ones).reshape(-1, 2)

    def log10(self, c: np.ndarray, t: np.ndarray, scored: np.ndarray, skip: int = 0) -> np.ndarray:
        """log10 probability of targets ``t`` at the places ``scored`` of windows ``c``, all of them from ``skip`` on."""
        x, _, _, _, mean = self.attend(c, skip)
        at = np.flatnonzero(scored[:, skip:])
        order, _, t, _, scores, _ = self.heads(x[:, skip:], mean, at, t[:, skip:].ravel()[at])
        rows = np.arange(len(at))
        hit = scores[rows, self.group[t]] + scores[rows, GROUPS + self.member[t]]
        out = np.empty(len(at), np.float32)
        out[order] = hit - np.log(self.summed(scores)).sum(1)
        return out / np.float32(np.log(10))

    def gradient(self, c: np.ndarray, t: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
        """Gradient of the cross-entropy, summed over all targets, and their number; t is -1 where there is nothing to predict. After ``ready``."""
        w = self.w
        flat = lambda z: z.reshape(-1, z.shape[-1])
        x, x_t, _, a, mean = self.attend(c)
        at = np.flatnonzero(t.ravel() >= 0)
        _, at, target, y, p, parts = self.heads(x, mean, at, t.ravel()[at])
        halves = p.reshape(-1, 2, MEMBERS)
        halves *= 1 / self.summed(p)[:, :, None]
        rows = np.arange(len(at))
        p[rows, self.group[target]] -= 1
        p[rows, GROUPS + self.member[target]] -= 1
        out = np.zeros_like(self.out)
        some = self.room("some", len(at), WIDTH)
        for k, rows in parts:
            np.matmul(y[rows].T, p[rows], out=out[k])
            np.matmul(p[rows], self.out_t[k], out=some[rows])
        dy = self.room("dy", *x.shape)
        if len(at) < flat(dy).shape[0]:
            dy[:] = 0
        flat(dy)[at] = some
        # y = x + mean VO, mean = a x, a = softmax(xQK'x')
        dvo = flat(mean).T @ flat(dy)
        sides, weights = self.room("q", len(c), 2 * WINDOW, WIDTH + 1), self.room("a", len(c), 2 * WINDOW, WINDOW)  # q and dmean, ds and a
        dmean, ds = sides[:, WINDOW:, :WIDTH], weights[:, :WINDOW]
        np.matmul(dy, self.vo_t, out=dmean)
        np.einsum("nij,nij->ni", dmean, mean, out=sides[:, WINDOW:, WIDTH])  # what the row of -1 takes off
        np.matmul(sides[:, WINDOW:], x_t, out=ds)
        ds *= a
        more = np.matmul(ds, x, out=self.room("more", *x.shape))
        dqk = flat(x).T @ flat(more) * np.float32(WIDTH**-0.5)
        dx = np.matmul(weights.transpose(0, 2, 1), sides[:, :, :WIDTH], out=self.room("dx", *x.shape))
        dx += dy
        dx += np.matmul(more, self.qk_t, out=dy)
        # sums of dx by id: by its upper bits in order, by its lower bits as a product
        upper, lower = np.divmod(c.ravel().astype(np.uint16), np.uint16(MEMBERS))
        order = np.argsort(upper.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(upper[order], np.arange(GROUPS + 1)).tolist()
        ranked = np.take(flat(dx), order, axis=0, out=flat(more), mode="clip")
        ones = flat(dy)
        ones[:] = 0
        ones[np.arange(len(order)), lower[order]] = 1
        de = np.zeros((GROUPS, MEMBERS, WIDTH), np.float32)
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            np.matmul(ones[i:j].T, ranked[i:j], out=de[k])
        g = {"E": de.reshape(IDS, WIDTH), "P": dx.sum(0), "Q": dqk @ w["K"], "K": dqk.T @ w["Q"], "V": dvo @ w["O"].T, "O": w["V"].T @ dvo}
        first, second = out[:, :, :GROUPS].sum(0), out[:, :, GROUPS:]
        return g | {"U": first[:WIDTH], "b": first[WIDTH], "Ug": second[:, :WIDTH], "bg": second[:, WIDTH]}, len(at)


class Adam:
    """Adam on the weights of a network; the rate rises over the first tenth of the steps and falls to a tenth."""

    def __init__(self, net: Attention, steps: int, rate: float = 0.03):
        self.net, self.steps, self.rate, self.step = net, steps, rate, 0
        self.m, self.s = ({k: np.zeros(v.shape) for k, v in net.w.items()} for _ in range(2))

    def take(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        lr = self.rate * min(1, self.step / max(1, self.steps / 10)) * (1 - 0.9 * self.step / self.steps)
        for name, w in self.net.w.items():
            self.m[name] = 0.8 * self.m[name] + 0.2 * g[name]
            self.s[name] = 0.95 * self.s[name] + 0.05 * g[name] ** 2
            w -= (lr * (self.m[name] / (1 - 0.8**self.step)) / (np.sqrt(self.s[name] / (1 - 0.95**self.step)) + 1e-8)).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences that lie one after the other: each window's sequence, first place, and first scored place."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    seq = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count)
    return seq, nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0)


def score_ids(ids: list[bytes], model: dict, batch: int = 256) -> np.ndarray:
    """log10 probability of each sequence of subword ids (16 bits each) and its end."""
    net, own_id, inside = model["net"], model["own"], model["inside"]
    lengths = np.array([len(x) // 2 + 1 for x in ids])
    flat = np.frombuffer(b"\0\0".join(ids) + b"\0\0", "<u2")
    ends = np.cumsum(lengths) - 1
    target = own_id.astype(np.int16)[flat]
    target[ends] = END
    target = np.append(target, np.full(WINDOW, END, np.int16))  # the last windows end there
    given = np.append(np.int16(END), target[:-1])  # after a text's end the next one starts
    given, target = (np.lib.stride_tricks.sliding_window_view(x, WINDOW) for x in (given, target))
    own = inside[flat]
    own[ends] = 0.0
    starts = ends - lengths + 1
    out = np.add.reduceat(own, starts)
    seq, first, skip = windows(lengths)
    place = np.arange(WINDOW)
    for none in (0, WINDOW - STRIDE):  # a text's first window, of which no place is skipped, and its other ones
        some = np.flatnonzero(skip == none)
        for b in range(0, len(some), batch):
            s, f = seq[some[b : b + batch]], first[some[b : b + batch]]
            scored = (place >= none) & (f[:, None] + place < lengths[s][:, None])
            at = starts[s] + f
            got = net.log10(given[at], target[at], scored, none)
            out += np.bincount(np.repeat(s, scored.sum(1)), got, len(out))
    return out


class PieceEncoder:
    """Encodes many texts at once, each distinct piece of them once.

    The pattern cuts at every single space between two characters that are not white space. Texts with
    other white space beside a space are encoded whole.
    """

    def __init__(self, enc: tiktoken.Encoding):
        self.enc = enc
        self.n_bytes = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)])

    def _ids(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def _spaced(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words that follow a space: some thousand in one call, cut where each word's bytes end."""
        flat, size = [], []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = self._ids(" " + " ".join(part))
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(w.encode()) + 1 for w in part])) + 1
            flat.append(ids)
            size.append(np.diff(ends, prepend=0))
        return flat, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none of them null), one after the other, 16 bits each, and each one's number of ids."""
        pieces = pc.split_pattern(texts, " ")
        begin = pieces.offsets.to_numpy()[:-1].astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        entry, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words])
        flat, size = self._spaced([w for w, other in zip(words, odd.tolist(), strict=True) if not other])
        # entries: words after a space, first words of texts, texts encoded whole
        entry_of = np.cumsum(~odd) - 1
        whole = np.logical_or.reduceat(odd[entry], begin)
        alone = [self._ids(words[i]) for i in entry[begin[~whole]].tolist()] + [self._ids(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        size = np.concatenate([*size, np.fromiter(map(len, alone), np.int64, len(alone))])
        flat = np.concatenate([*flat, *alone])
        n_words = len(words) - int(odd.sum())
        entry = entry_of[entry]
        entry[begin[~whole]] = n_words + np.arange((~whole).sum())
        n = size[entry]
        n[np.repeat(whole, np.diff(np.append(begin, len(entry))))] = 0
        entry[begin[whole]] = n_words + (~whole).sum() + np.arange(whole.sum())
        n[begin[whole]] = size[entry[begin[whole]]]
        return ragged(flat, (np.cumsum(size) - size)[entry], n), np.add.reduceat(n, begin)


def encoded(docs: DataFrame, learn: Column, tokenizer: str) -> DataFrame:
    """_row, learn, ids: the subword ids of each whole text, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(encoding(tokenizer))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size = enc.encode(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            ends = pa.py_buffer((2 * np.append(0, np.cumsum(size))).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(size), [None, ends, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("learn"), ids], names=["_row", "learn", "ids"])

    return docs.select("_row", learn.alias("learn"), "text").mapInArrow(tidied(run, most=8 << 20), "_row long, learn boolean, ids binary")


def _summed(rows: DataFrame, column: str, size: int, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sums over tasks of arrays of ``size`` whole numbers that ``task`` gives for its part of a column; ``LANES`` of them a row, at most ``size`` come to the driver."""
    lanes, n = [f"g{k}" for k in range(LANES)], -(-size // LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((n, LANES), np.int64)
        held.reshape(-1)[:size] = task(batches)
        seen = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array(x) for x in np.ascontiguousarray(held[seen].T))], names=["i", *lanes])

    got = rows.select(column).mapInArrow(tidied(run), ", ".join(f"{k} long" for k in ["i", *lanes])).groupBy("i").agg(*(F.sum(k).alias(k) for k in lanes)).toArrow()
    out = np.zeros((n, LANES))
    out[got.column("i").to_numpy()] = np.stack([got.column(k).to_numpy() for k in lanes], 1)
    return out.ravel()[:size]


def _counted(rows: DataFrame, count: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sums over a table of an array of ``size`` numbers, which ``count`` gives for a list of sequences."""

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for x in batch.column("ids"):
                held.append(np.frombuffer(x.as_py(), "<u2"))
                n += len(held[-1])
                if n > 2_000_000:
                    sums += count(held)
                    held, n = [], 0
        return sums + count(held) if held else sums

    return _summed(rows, "ids", size, task)


def id_counts(rows: DataFrame) -> np.ndarray:
    """Number of each subword id in all sequences of a table."""
    return _counted(rows, lambda held: np.bincount(np.concatenate(held), minlength=1 << 16), 1 << 16)


def own_ids(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's id of each subword id, and log10 of the latter's probability given the former."""
    order = np.argsort(-counts, kind="stable")
    own = np.full(len(counts), RARE)
    own[order[: IDS - 2]] = np.arange(IDS - 2)
    smooth = counts + 0.1
    return own, np.log10(smooth / np.bincount(own, smooth, IDS)[own])


def pair_counts(rows: DataFrame, own: np.ndarray) -> np.ndarray:
    """How often each of the network's ids follows each other one, over all sequences of a table, with their starts and ends."""
    shared = rows.sparkSession.sparkContext.broadcast(own.astype(np.uint16))

    def count(held: list[np.ndarray]) -> np.ndarray:
        t = np.concatenate([np.append(shared.value[x], np.uint16(END)) for x in held]).astype(np.int64)
        return np.bincount(np.r_[END, t[:-1]] * IDS + t, minlength=IDS * IDS)

    return _counted(rows, count, IDS * IDS).reshape(IDS, IDS)


def regrouped(pairs: np.ndarray) -> np.ndarray:
    """An order of ids in which each ``MEMBERS`` in a row are a group of ids that follow the same ones: cut in halves, again and again, along the widest direction."""
    p, row = (pairs.sum(0) + 1) / (pairs.sum() + IDS), pairs.sum(1)
    lift = np.log((pairs + 20 * p) / (row[:, None] + 20) / p)
    _, s, v = np.linalg.svd(np.sqrt((row + 1) / (row.sum() + IDS))[:, None] * lift * np.sqrt(p), full_matrices=False)
    x = v[:8].T * s[:8] / np.sqrt(p)[:, None]

    def halves(of: np.ndarray) -> np.ndarray:
        if len(of) == MEMBERS:
            return of
        y = x[of] - x[of].mean(0)
        of = of[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
        return np.concatenate([halves(of[: len(of) // 2]), halves(of[len(of) // 2 :])])

    return halves(np.arange(IDS))


def start_from(net: Attention, pairs: np.ndarray) -> None:
    """Groups, and weights with which the network, before attention, tells what the counts of pairs tell, as far as its width allows."""
    order = regrouped(pairs)
    net.group[order], net.member[order] = np.divmod(np.arange(IDS), MEMBERS)
    p, row = (pairs.sum(0) + 1) / (pairs.sum() + IDS), pairs.sum(1, keepdims=True)
    to_group = pairs[:, order].reshape(IDS, GROUPS, MEMBERS).sum(2)
    pg = p[order].reshape(GROUPS, MEMBERS).sum(1)
    pm = p / pg[net.group]
    lift = np.log(np.concatenate([(to_group + 20 * pg) / (row + 20) / pg, (pairs + 20 * pm) / (to_group[:, net.group] + 20) / pm], 1))
    left, right = np.sqrt((row + 1) / (row.sum() + IDS)), np.sqrt(np.concatenate([pg, p]))
    u, s, v = np.linalg.svd(left * lift * right, full_matrices=False)
    u, s, v = u[:, :WIDTH], np.sqrt(s[:WIDTH]), v[:WIDTH]
    even = np.sqrt(np.sqrt((v**2 / right**2).sum() / (u**2 / left**2).sum()))
    out = (s[:, None] * v / right / even).astype(np.float32)
    net.w["E"], net.w["U"] = (u * s / left * even).astype(np.float32), out[:, :GROUPS]
    net.w["Ug"] = np.ascontiguousarray(out[:, GROUPS:][:, order].reshape(WIDTH, GROUPS, MEMBERS).transpose(1, 0, 2))
    net.w["b"], net.w["bg"] = np.log(pg).astype(np.float32), np.log(pm[order]).reshape(GROUPS, MEMBERS).astype(np.float32)


#: In packed windows: nothing to predict.
NOTHING = 65535
#: Windows that one task adds up in one step; a step of fewer than eight such tasks has up to eight smaller ones.
TASK_WINDOWS = 16_384
#: Gradients are summed as whole numbers of this part, so that their sum does not depend on the order of tasks.
GRAIN = 2.0**24


def training_windows(rows: DataFrame, own: np.ndarray, steps: int, one_in: int, parts: int | None = None) -> DataFrame:
    """step, part, windows: one in ``one_in`` of the windows of ``WINDOW`` targets, after the id before them, into which all sequences are cut.

    A text's windows are dealt in turn from a place given by its checksum, so that each step has
    windows from all parts of the texts. With a number of ``parts`` of a step, windows of many texts that
    go to the same part are one row; without, each is a row.
    """
    shared = rows.sparkSession.sparkContext.broadcast(own.astype("<u2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for raw in batch.column("ids"):
                held.append(raw.as_py())
                n += len(held[-1])
                if n > 2_000_000:
                    yield packed(held)
                    held, n = [], 0
            if held:
                yield packed(held)

    def packed(ids: list[bytes]) -> pa.RecordBatch:
        """Windows of some texts: each a row of ``WINDOW`` + 1 ids."""
        lengths = np.array([len(x) // 2 + 1 for x in ids])
        count = -(-lengths // WINDOW)
        text = np.repeat(np.arange(len(ids)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        turn = np.array([zlib.crc32(x) for x in ids])[text] + nth
        text, nth, turn = (x[turn % one_in == 0] for x in (text, nth, turn))
        flat = shared.value[np.frombuffer(b"\0\0".join(ids) + b"\0\0", "<u2")]
        ends = np.cumsum(lengths)
        flat[ends - 1] = END
        flat = np.concatenate([flat[-1:], flat, np.full(WINDOW, NOTHING, flat.dtype)])  # an end goes before each text
        rows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 1)[(ends - lengths)[text] + nth * WINDOW]
        last = np.flatnonzero(nth == count[text] - 1)
        rows[last] = np.where(nth[last, None] * WINDOW + np.arange(-1, WINDOW) < lengths[text[last], None], rows[last], NOTHING)
        step, part = turn // one_in % steps, turn // one_in // steps
        begin = np.arange(len(rows))
        if parts:
            key = part % parts * steps + step
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            step, part = key[begin] % steps, key[begin] // steps
        offsets = pa.py_buffer((np.append(begin, len(rows)) * 2 * (WINDOW + 1)).astype(np.int32))
        binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows, "<u2"))])
        return pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(part, pa.int64()), binary], names=["step", "part", "windows"])

    return rows.select("ids").mapInArrow(tidied(cut), "step int, part long, windows binary")


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids before each target, and targets (-1 for none), of packed windows."""
    rows = np.frombuffer(raw, "<i2").reshape(-1, WINDOW + 1)  # NOTHING is read as -1
    return np.where(rows[:, :-1] < 0, np.int16(END), rows[:, :-1]), rows[:, 1:]


def summed_gradient(rows: DataFrame, net: Attention) -> tuple[dict[str, np.ndarray], int]:
    """Gradient over all windows of a table: summed in the tasks, then on Spark; one number for each weight comes to the driver."""
    shapes = {k: v.shape for k, v in net.w.items()}
    cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    net.ready()

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, n = np.zeros(cuts[-1]), 0
        for batch in batches:
            c, t = unpacked(b"".join(batch.column("windows").to_pylist()))
            for b in range(0, len(c), 256):
                g, some = net.gradient(c[b : b + 256], t[b : b + 256])
                total += np.concatenate([g[k].ravel() for k in shapes])
                n += some
        return np.append(np.rint(total * GRAIN).astype(np.int64), n)

    whole = _summed(rows, "windows", int(cuts[-1]) + 1, add)
    if not whole[-1]:
        return {}, 0
    return {k: g.reshape(s) / GRAIN for (k, s), g in zip(shapes.items(), np.split(whole[:-1], cuts[:-1]), strict=True)}, int(whole[-1])


def train(rows: DataFrame, steps: int = 48, one_in: int = 1) -> dict:
    """The network for encoded texts (ids), from all their counts and all their windows (or one in ``one_in``), a part of them in each of ``steps`` steps."""
    own, inside = own_ids(id_counts(rows))
    net = Attention()
    pairs = pair_counts(rows, own)
    if not pairs.sum():
        net.w = {k: v * 0 for k, v in net.w.items()}
        return {"net": net.ready(), "own": own, "inside": inside}
    start_from(net, pairs)
    # windows in all, from the number of ids; a text has one that is not full
    tasks = pairs.sum() / WINDOW / one_in / steps / TASK_WINDOWS
    parts = int(np.ceil(max(tasks, min(8, 8 * tasks))))
    path = stored(training_windows(rows, own, steps, one_in, parts).repartition("step", "part"), "windows", "step")
    adam = Adam(net, steps)
    for step in range(steps):
        g, n = summed_gradient(path.where(F.col("step") == step), net)
        if n:
            adam.take({k: x / n for k, x in g.items()})
    return {"net": net.ready(), "own": own, "inside": inside}


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case (A-Z) words between white space of ASCII; an empty one before white space that begins a text and after such that ends it, and in one that is null or empty."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all rows of ``docs``; END_WORD counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            seen = split_words(batch.column("text")).flatten().value_counts()
            held.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}).filter(pc.field("word") != ""))
            held.append(pa.table({"word": [END_WORD], "n": pa.array([batch.num_rows], pa.int64())}))
            if sum(map(len, held)) > 400_000:
                held = [summed()]
                if len(held[0]) > 200_000:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return docs.select("text").mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, top_words: int) -> dict[str, int]:
    """At most ``top_words`` words and their counts, and END_WORD: all from a least count on, found from a histogram of counts' logarithms."""
    level = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for k, words in sorted(((r.k, r.words) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("words")).collect()), reverse=True):
        if held + words > top_words:
            break
        least, held = k, held + words
    rows = counts.where((level >= least if least is not None else F.lit(False)) | (F.col("word") == END_WORD)).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))


def base_scores(docs: DataFrame, counts: DataFrame, top_words: int) -> tuple[DataFrame, int]:
    """_row, doc_id, n_tokens, n_known, base_score; and the number of all tokens counted."""
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    bottom = float(np.log10(n + v + 1))
    shared = docs.sparkSession.sparkContext.broadcast(most_frequent(counts, top_words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: float(np.log10(c + 1)) - bottom for w, c in shared.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = split_words(batch.column("text"))
            begin = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            log = np.array([logs.get(w, np.nan) for w in words])
            word, found = np.array([w != "" for w in words]), ~np.isnan(log)
            total = lambda x: np.add.reduceat(x[which], begin)  # noqa: B023, E731
            rest = (word & ~found)[which]
            ends = np.append(0, np.cumsum(np.add.reduceat(rest.astype(np.int64), begin)))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(coded.indices.filter(pa.array(rest))))
            known, base = total(found.astype(np.int64)) + (END_WORD in logs), total(np.where(found, log, 0.0)) + logs.get(END_WORD, -bottom)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(total(word.astype(np.int64)) + 1), pa.array(known), pa.array(base), rare], names=["_row", "doc_id", "n_tokens", "n_known", "base", "rare"])

    done = stored(docs.mapInArrow(tidied(score), "_row long, doc_id long, n_tokens long, n_known long, base double, rare array<string>"), "base")
    rare = done.select("_row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("_row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(bottom)).alias("more"), F.count("n").alias("found"))
    done = done.join(rare, "_row", "left").select("_row", "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"))
    return done, n


def model_scores(rows: DataFrame, model: dict) -> DataFrame:
    """_row, score of encoded texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 500):
                part = batch.slice(b, 500)
                got = score_ids(part.column("ids").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(got, pa.float64())], names=["_row", "score"])

    return rows.select("_row", "ids").mapInArrow(tidied(score), "_row long, score double")


def held_out() -> Column:
    return id_crc32("doc_id") % 7 == 2


def score_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", top_words: int = 200_000, **training: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    docs = keyed(docs, "doc_id", "text").select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(encoded(docs, ~held_out(), tokenizer), "ids")
    scores = model_scores(rows, train(rows.where("learn"), **training))
    done, n = base_scores(docs, stored(count_words(docs.where(~held_out())), "counts"), top_words)
    return done.join(scores, "_row").select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
