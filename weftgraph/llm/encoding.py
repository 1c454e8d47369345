"""Whole-text encoding with the tokenizers library, one cached encoding per word."""

from __future__ import annotations

import os

_OWN: dict[str, Encoder] = {}
#: After a letter or digit and before white space each of these is a pre-token of its own.
MARKS = b".,"
#: Bytes that a cached word takes, about: its text, its ids, its places.
ENTRY = 48


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file; its cache serves one task after another."""
    if path not in _OWN:
        _OWN[path] = Encoder(path)
    return _OWN[path]


def forget() -> None:
    """Frees this process's encoders; called by tasks that no longer encode but may run in a process that did."""
    if _OWN:
        import ctypes
        import gc

        import pyarrow as pa

        _OWN.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
        if trim:
            trim(0)


class Encoder:
    """ids(text) equals encode(text, add_special_tokens=False).ids of the file's tokenizer, special strings taken as text.

    Both kinds of pre-tokenizer here start a new pre-token at a space that has a non-space on either side, so a text is the
    sequence of its words' encodings, each with the space before it. Where the tokenizer drops white space, any of the
    ASCII kind parts words; else a text with a space next to other white space, or at an end, is encoded as it stands.
    Where it ignores the case of ASCII letters, texts are lowered first. Arrow splits texts, numbers their distinct words
    and looks them up; numpy lays out the ids. The cache holds about max_bytes, then words not met for longest go; texts
    are taken in slices of about slice_chars characters. Neither changes a result."""

    def __init__(self, path: str, max_bytes: int = 20_000_000, slice_chars: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.most, self.slice_chars = max(1, max_bytes // ENTRY), slice_chars
        self.ends = self._boundaries()
        self.folds = self._ids("A") == self._ids("a")
        self.drops = self._ids("a b c d e f g") == self._ids(" a\tb\nc\x0bd \x0ce\r\nf  g\n ")
        self.marks = np.zeros(256, np.uint32)
        for m in MARKS:
            own = self._ids(chr(m))
            self.marks[m] = own[0] if len(own) == 1 else 0
        # the cache: words, their ids one after another, sizes (-1: stands next to white space) and when last met
        self.words = pa.array([], pa.large_string())
        self.flat, self.sizes, self.met, self.now = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        self.first: dict[str, list[int]] = {}

    def _boundaries(self):
        """Which ids end a pre-token (a word-end mark), or open one (the byte-level mark of a space); None if ids don't tell."""
        import numpy as np

        vocabulary = self.tokenizer.get_vocab()
        for last, test in ((True, lambda w: w.endswith("</w>")), (False, lambda w: w.startswith("Ġ"))):
            marked = [i for w, i in vocabulary.items() if test(w)]
            if len(marked) > 1000:
                out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
                out[marked] = True
                return last, out
        return None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, words: list[str]):
        """(ids one after another, sizes) of words, each with a space before it. Words of letters alone are one pre-token each:
        they are encoded as one text and told apart by the marks, of which there must be as many as words."""
        import numpy as np

        sizes, place = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if w.isalpha()] if self.ends else []
        rest, ids = range(len(words)), np.zeros(0, np.uint32)
        if len(plain) >= 8:
            last, mark = self.ends
            got = self.tokenizer.encode_batch_fast([" " + " ".join([words[i] for i in plain])], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype=np.uint32)
            at = np.flatnonzero(mark[ids])
            if len(at) == len(plain) and (last or at[0] == 0):
                cuts = np.concatenate(([0], at + 1)) if last else np.append(at, len(ids))
                place[plain], sizes[plain] = cuts[:-1], np.diff(cuts)
                done = set(plain)
                rest = [i for i in rest if i not in done]
            else:
                ids = ids[:0]
        more, n = [ids], len(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([" " + words[i] for i in rest], add_special_tokens=False)):
            own = np.array(e.ids, dtype=np.uint32)
            more.append(own)
            place[i], sizes[i] = n, len(own)
            n += len(own)
        ids, starts = np.concatenate(more), np.cumsum(sizes, dtype=np.int64) - sizes
        return ids[np.repeat(place - starts, sizes) + np.arange(n)], sizes

    def _add(self, missing) -> None:
        """Words of an Arrow array to the cache."""
        import numpy as np
        import pyarrow as pa

        words = missing.to_numpy(zero_copy_only=False).tolist()
        odd = [] if self.drops else [i for i, w in enumerate(words) if not w or w[0].isspace() or w[-1].isspace()]
        for i in odd:
            words[i] = ""
        ids, sizes = self._encoded(words)
        if odd:  # no text is laid out of them
            keep = np.repeat(~np.isin(np.arange(len(words)), odd), sizes)
            ids, sizes[odd] = ids[keep], -1
        self.words = pa.concat_arrays([self.words, missing])
        self.flat, self.sizes = np.concatenate((self.flat, ids)), np.concatenate((self.sizes, sizes))
        self.met = np.concatenate((self.met, np.full(len(words), self.now)))

    def _shrink(self) -> None:
        """Beyond the cache's bound the half met last stays."""
        import numpy as np
        import pyarrow as pa

        if len(self.words) > self.most:
            keep = np.sort(np.argsort(-self.met, kind="stable")[:self.most // 2])
            which = np.zeros(len(self.words), bool)
            which[keep] = True
            self.flat = self.flat[np.repeat(which, np.maximum(self.sizes, 0))]
            self.words, self.sizes, self.met = self.words.take(pa.array(keep)), self.sizes[keep], self.met[keep]
        if len(self.first) > self.most:
            self.first.clear()

    def encode(self, texts: list[str]) -> list:
        """Each text's ids as a uint32 array."""
        out, at, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= self.slice_chars:
                out += self._some(texts[at:k + 1])
                at, size = k + 1, 0
        return out + self._some(texts[at:]) if at < len(texts) else out

    def _split(self, texts: list[str]):
        """(words without their marks, marks by word or 0, bounds of the texts)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.array(texts, pa.large_string())
        if self.folds:
            rows = pc.ascii_lower(rows)
        split = pc.ascii_split_whitespace(rows) if self.drops else pc.split_pattern(rows, " ")
        bounds, words = split.offsets.to_numpy(), split.values
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        data = np.concatenate((np.zeros(3, np.uint8), data[offsets[0]:offsets[-1]]))
        ends = offsets[1:] - offsets[0] + 3
        last, before, third = data[ends - 1], data[ends - 2], data[ends - 3]
        low = before | 0x20
        letter = ((low >= 97) & (low <= 122)) | ((before >= 48) & (before <= 57)) | ((third == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80))
        marked = (self.marks[last] > 0) & letter & (np.diff(offsets) > 1)
        marked &= (before < 0x80) | (np.diff(offsets) > 2)
        marks = np.where(marked, last, 0)
        keep = np.ones(len(data), bool)
        keep[:3], keep[ends[marked] - 1] = False, False
        cut = np.concatenate(([0], ends - 3 - np.cumsum(marked)))
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data[keep])), marks, bounds

    def _some(self, texts: list[str]) -> list:
        import numpy as np
        import pyarrow.compute as pc

        self.now += 1
        words, marks, bounds = self._split(texts)
        numbered = words.dictionary_encode()
        code, distinct = numbered.indices.to_numpy(), numbered.dictionary
        at = pc.index_in(distinct, value_set=self.words)
        missing = distinct.filter(pc.is_null(at))
        known = at.fill_null(-1).to_numpy().astype(np.int64)
        self.met[known[known >= 0]] = self.now
        known[known < 0] = len(self.words) + np.arange(len(missing))
        if len(missing):
            self._add(missing)
        sizes = self.sizes[known]
        real = np.maximum(self.sizes, 0)
        starts = (np.cumsum(real, dtype=np.int64) - real)[known][code]
        flat, lens = self.flat, sizes[code]
        whole = np.zeros(len(texts), bool)
        if not self.drops:
            whole = np.add.reduceat(lens < 0, bounds[:-1]) > 0
            heads = distinct.take(numbered.indices.take(bounds[:-1])).to_pylist()
            own = [self.first.get(w) or self.first.setdefault(w, self._ids(w)) for w in heads]
            lens = np.maximum(lens, 0)
            lens[bounds[:-1]] = [len(x) for x in own]
            starts[bounds[:-1]] = len(flat) + np.cumsum([0, *map(len, own)])[:-1]
            flat = np.concatenate((flat, *[np.array(x, np.uint32) for x in own]))
        self._shrink()
        lens = lens + (marks > 0)
        ends = np.cumsum(lens, dtype=np.int64)
        flat = np.append(flat, np.uint32(0))
        ids = flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        ids[ends[marks > 0] - 1] = self.marks[marks[marks > 0]]
        cuts = np.concatenate(([0], ends))[bounds].tolist()
        out = [ids[x:y] for x, y in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self._ids(texts[i]), dtype=np.uint32)
        return out

    def ids(self, text: str):
        return self.encode([text])[0]
