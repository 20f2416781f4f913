"""Exact tokenizer output for whole texts from a table of words, over Arrow buffers cut by bytes.

Both vocabularies never join text over a lone space or line feed between two characters that are not white space: byte-level
BPE starts a new piece there, the word vocabulary drops it. So a text may be cut there, each part encoded alone, and the ids
joined. Parts are mostly words, which repeat. Each is looked up by 128 bits of hash in an open-addressing table of
bounded size, all words of a slice in a few array operations; those not in it are encoded by the library in joint calls, with a separator between them.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.common import WORKER_CACHES, SpanHasher, mix64, slices, string_buffers

#: Signs after a Latin letter: always a piece of their own in both vocabularies. Only letters that no normalization changes to more than one; no apostrophes (contractions) and nothing of special strings or separators.
_TAIL = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]([!-&(-;=?@\[-`{}~]+)\Z")
TABLE_WORDS = 1_500_000
SLICE = 1 << 19
JOINT_CALL = 2000
SPACE, LINE_FEED = 0x20, 0x0A
AT_START, AFTER_SPACE, AFTER_LINE_FEED = 0, 1, 2


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ascii_white() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    return t


_WHITE = _ascii_white()


def _white_char(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether bytes a, b, c start with a character of white space beyond ASCII: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return two | general | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the parts between safe cuts of each row, in order."""
    n = len(data)
    live = np.diff(off) > 0
    edge = np.zeros(n, bool)
    edge[off[:-1][live]] = True
    edge[off[1:][live] - 1] = True
    p = np.flatnonzero(((data == SPACE) | (data == LINE_FEED)) & ~edge)
    p = p[~(_WHITE[data[p - 1]] | _WHITE[data[p + 1]])]
    beyond = np.flatnonzero((data[p - 1] >= 0x80) | (data[p + 1] >= 0xC2))
    if len(beyond):
        q = p[beyond]
        at = lambda i: data[np.clip(i, 0, n - 1)]
        bad = _white_char(at(q + 1), at(q + 2), at(q + 3)) | _white_char(at(q - 2), at(q - 1), at(q - 1)) | _white_char(at(q - 3), at(q - 2), at(q - 1))
        p = np.delete(p, beyond[bad])
    start = np.concatenate([off[:-1][live], p + 1])
    kind = np.concatenate([np.zeros(int(live.sum()), np.int8), np.where(data[p] == SPACE, AFTER_SPACE, AFTER_LINE_FEED).astype(np.int8)])
    order = np.argsort(start, kind="stable")
    return start[order], np.sort(np.concatenate([off[1:][live], p])), kind[order]


class WordTable:
    """Ids by 128-bit hash: rows (hash, hash, place in the pool and number of ids) in open addressing, half of them free. Words met again since the last trim survive it."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self._reset(1 << 12)

    def _reset(self, size: int) -> None:
        self.rows, self.used, self.count = np.zeros((size, 3), np.uint64), np.zeros(size, bool), 0
        self.shift = np.uint64(65 - size.bit_length())
        self.pool, self.filled = np.empty(1 << 14, np.uint32), 0

    def find(self, h: np.ndarray, c: np.ndarray, met: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether held, place, ids) of each word; met: the words that are held count as met again."""
        slot, mask = (h >> self.shift).astype(np.int64), len(self.rows) - 1
        row = self.rows[slot]
        held = (row[:, 0] == h) & (row[:, 1] == c)
        todo = np.flatnonzero(~held & (row[:, 0] != 0))
        while len(todo):
            slot[todo] = s = (slot[todo] + 1) & mask
            other = self.rows[s]
            same = (other[:, 0] == h[todo]) & (other[:, 1] == c[todo])
            row[todo[same]], held[todo[same]] = other[same], True
            todo = todo[~same & (other[:, 0] != 0)]
        if met:
            self.used[slot[held]] = True
        return held, *self._unpack(row[:, 2])

    @staticmethod
    def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)

    @staticmethod
    def _pack(place: np.ndarray, n: np.ndarray) -> np.ndarray:
        return place.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)

    def add(self, h: np.ndarray, c: np.ndarray, ids: list[bytes]) -> None:
        """Different words that aren't held."""
        if 2 * (self.count + len(h)) > len(self.rows):
            at = np.flatnonzero(self.rows[:, 0])
            self._keep(at, self.used[at], 1 << (2 * (self.count + len(h))).bit_length())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = self._pour(np.frombuffer(b"".join(ids), "<u4")) + np.cumsum(size) - size
        self._put(np.column_stack([h, c, self._pack(place, size)]), np.zeros(len(h), bool))

    def _pour(self, ids: np.ndarray) -> int:
        at, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(self.filled + self.filled // 4 - at, np.uint32)])
        self.pool[at : self.filled] = ids
        return at

    def _put(self, rows: np.ndarray, used: np.ndarray) -> None:
        slot, mask, todo = (rows[:, 0] >> self.shift).astype(np.int64), len(self.rows) - 1, np.arange(len(rows))
        self.count += len(rows)
        while len(todo):
            free = todo[self.rows[slot[todo], 0] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.rows[slot[won]], self.used[slot[won]] = rows[won], used[won]
            placed = np.zeros(len(rows), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _keep(self, at: np.ndarray, used: np.ndarray, size: int) -> None:
        """Only the words in these slots, in a table of that size."""
        rows, pool = self.rows[at], self.pool
        self._reset(size)
        place, n = self._unpack(rows[:, 2])
        rows[:, 2] = self._pack(self._pour(pool[spread(place, n)]) + np.cumsum(n) - n, n)
        self._put(rows, used)

    def trim(self) -> None:
        """Called between slices: above the limit, of words or of 16 ids a word, only words met again since the last trim stay, at most half the limit."""
        if self.count <= self.limit and self.filled <= 16 * self.limit:
            return
        at = np.flatnonzero((self.rows[:, 0] != 0) & self.used)
        few = at[self._unpack(self.rows[at, 2])[1] <= 64][: self.limit // 2]
        self._keep(few, np.zeros(len(few), bool), len(self.rows))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) + np.repeat(start - total + n, n)


class WordCacheEncoder:
    """ids of whole texts, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them.

    path: vocabulary file. separator: text of one token that stands between new words in a joint call and is never part of another token.
    words bounds the table, whatever the corpus.
    """

    def __init__(self, path: str, separator: str, words: int = TABLE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.separator, self.mark = separator, separator.lstrip(" ")
        (self.sep_id,) = self.tok.encode(separator, add_special_tokens=False).ids
        self.table, self.tails, self.one, self.two = WordTable(words), {}, SpanHasher(31), SpanHasher(32)
        names = self.tok.get_vocab()
        size = max(names.values()) + 1
        self.ends, self.starts = np.zeros(size, bool), np.zeros(size, bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.starts[[i for t, i in names.items() if t.startswith("Ġ")]] = True
        self.by_end = bool(self.ends.any())  # white space is dropped where tokens end words
        self.line_feed = self._direct("\n")

    def _direct(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each part and, where it matters, of what is before it."""
        h = self.one.spans(self.one.prefix(data), start, end)
        if not self.by_end:
            h = mix64(h + kind.astype(np.uint64))
        return np.maximum(h, np.uint64(1)), self.two.spans(self.two.prefix(data), start, end)

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, ids) in the pool of each part of one slice."""
        self.table.trim()
        h, c = self._hashes(data, start, end, kind)
        held, place, n = self.table.find(h, c)
        while not held.all():
            miss = np.flatnonzero(~held)
            _, first = np.unique(h[miss], return_index=True)
            new = miss[np.sort(first)]
            self._learn(data, start[new], end[new], kind[new], h[new], c[new])
            held, place, n = self.table.find(h, c, met=False)
        return place, n

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        """Parts that aren't held: a stem before signs is encoded once, and held as a word of its own."""
        raw, spaced = data.tobytes(), self.by_end
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        tails = [""] * len(words)
        for i, w in enumerate(words):
            if not w.isalpha() and (m := _TAIL.search(w)):
                words[i], tails[i] = w[: m.start(1)], m[1]
        lead = (kind == AFTER_SPACE) | spaced
        ids: dict[tuple[str, bool], bytes] = {}
        cut = [i for i, t in enumerate(tails) if t]
        if cut:  # stems held already, or to be held from now on
            stems = dict.fromkeys((words[i], bool(lead[i])) for i in cut)
            size = np.array([len(w.encode()) for w, _ in stems])
            stop = np.cumsum(size)
            flat = np.frombuffer("".join([w for w, _ in stems]).encode(), np.uint8)
            sh, sc = self._hashes(flat, stop - size, stop, np.array([AFTER_SPACE if x else AT_START for _, x in stems]))
            held, place, n = self.table.find(sh, sc, met=False)
            for k, (stem, ok, a, m) in enumerate(zip(stems, held.tolist(), place.tolist(), n.tolist(), strict=True)):
                if ok:
                    ids[stem] = self.table.pool[a : a + m].astype("<u4").tobytes()
                stems[stem] = k
        wanted = dict.fromkeys((w, bool(x)) for w, x in zip(words, lead.tolist(), strict=True))
        for flag, before in ((True, " "), (False, "")):
            some = [w for w, x in wanted if x == flag and (w, x) not in ids]
            got: dict[str, bytes] = {}
            self._encode(some, before, got)
            ids.update([((w, flag), v) for w, v in got.items()])
        for t in {t for t in tails if t} - self.tails.keys():
            self.tails[t] = self._direct(t)
        broken = (kind == AFTER_LINE_FEED) & (not spaced)
        whole = [(self.line_feed if b else b"") + ids[w, bool(x)] + (self.tails[t] if t else b"") for w, x, t, b in zip(words, lead.tolist(), tails, broken.tolist(), strict=True)]
        if cut:
            own = set(zip(h.tolist(), c.tolist(), strict=True))
            more = [(k, s) for s, k in stems.items() if not held[k] and (int(sh[k]), int(sc[k])) not in own]
            at = [k for k, _ in more]
            h, c, whole = np.concatenate([h, sh[at]]), np.concatenate([c, sc[at]]), whole + [ids[s] for _, s in more]
        if len(self.tails) > 50_000:
            self.tails.clear()
        self.table.add(h, c, whole)

    def _encode(self, words: list[str], before: str, into: dict[str, bytes]) -> None:
        """Words of letters alone are told apart by tokens that end a word or start after a space, others by separators."""
        plain, letters = [], []
        for w in words:
            if before and w.isalpha():
                letters.append(w)
            elif "<" in w or ">" in w or self.mark in w or not w or w[0].isspace() or w[-1].isspace():
                into[w] = self._direct(before + w)
            else:
                plain.append(w)
        for i in range(0, len(letters), JOINT_CALL):
            some = letters[i : i + JOINT_CALL]
            ids = self._ids(" " + " ".join(some))
            at = np.flatnonzero(self.ends[ids]) + 1 if self.by_end else np.append(np.flatnonzero(self.starts[ids])[1:], len(ids))
            if len(at) == len(some) and at[-1] == len(ids):
                self._store(some, ids, np.concatenate([[0], at[:-1]]), at, into)
            else:
                plain += some
        for i in range(0, len(plain), JOINT_CALL):
            some = plain[i : i + JOINT_CALL]
            ids = self._ids(self.separator.join([before + w for w in some]))
            at = np.flatnonzero(ids == self.sep_id)
            self._store(some, ids, np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]]), into)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _store(words: list[str], ids: np.ndarray, start: np.ndarray, end: np.ndarray, into: dict[str, bytes]) -> None:
        raw = ids.tobytes()
        for w, a, b in zip(words, (start * 4).tolist(), (end * 4).tolist(), strict=True):
            into[w] = raw[a:b]

    def rows(self, data: np.ndarray, off: np.ndarray, lengths_only: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(row from, row to, ids of each row, all ids) over ranges of rows; a text over SLICE bytes is a range of its own, looked up in pieces that end at safe cuts."""
        for i, j in slices(off, SLICE):
            own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            start, end, kind = parts(own, at)
            sizes, pools, a = [], [], 0
            while a < len(start):
                b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE, "right")))
                lo = int(start[a])
                place, n = self._look_up(own[lo : int(end[b - 1])], start[a:b] - lo, end[a:b] - lo, kind[a:b])
                sizes.append(n)
                if not lengths_only:
                    pools.append(self.table.pool[spread(place, n)])
                a = b
            total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
            rows = np.diff(total[np.searchsorted(start, at, "left")])
            yield i, j, rows, None if lengths_only else np.concatenate(pools) if pools else np.empty(0, np.uint32)

    def rows_with_end(self, data: np.ndarray, off: np.ndarray, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row from, row to, borders of the rows' ids, all ids) with end_id after each row."""
        for i, j, n, ids in self.rows(data, off):
            yield i, j, np.concatenate([[0], np.cumsum(n + 1)]), np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        data, off = string_buffers(pa.array(list(texts), pa.large_string()))
        for _, _, n, ids in self.rows(data, off):
            yield from np.split(ids, np.cumsum(n)[:-1])


@functools.lru_cache(4)
def encoder(name_or_path: str, separator: str, words: int = TABLE_WORDS) -> WordCacheEncoder:
    """One for each vocabulary and Python worker, so that later tasks find the words of earlier ones."""
    return WordCacheEncoder(name_or_path if os.sep in name_or_path else vocabulary_path(name_or_path), separator, words)


WORKER_CACHES.append(encoder)
