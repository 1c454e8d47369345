"""Tokens of each document, from pieces counted once per distinct pre-token.

Texts are parted into pre-tokens by the tokenizer file's own normalizer and pre-tokenizer. A slice of documents, about
``slice_chars`` characters, becomes one row: its distinct pre-tokens, and how often each of its documents holds each of them (a
sparse matrix, packed). The pre-tokens of all slices are dealt and sorted by their text, so that equal ones are neighbours; the
tokenizer's model counts the pieces of each distinct one once and hands the number to its slices. The numbers are gathered by
slice, joined to it and multiplied with its matrix. No ids are made, and no text travels twice.

A slice names a pre-token once, however often its documents hold it, so no pre-token is a hot key: it has a row a slice at most, beside the
slice's other ones. A slice has at least one document, so what is gathered for one is bounded by its characters or by one text.

Special strings in a text are special tokens, as the library has it by default: a word that holds one is counted whole.

Null text: empty, no tokens. Null doc_id and repeated rows: a row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, narrow

SLICES = "slice long, doc_ids array<long>, n_bytes array<long>, pieces array<string>, matrix binary"
_OWN: dict[str, Parts] = {}


def parts_of(path: str) -> Parts:
    """This process's Parts of a tokenizer file."""
    if path not in _OWN:
        _OWN[path] = Parts(path)
    return _OWN[path]


class Parts:
    """A tokenizer file's way from words to pre-tokens to numbers of pieces."""

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.known = most, {}

    def pre_tokens(self, words: list[str]) -> list[tuple[str, ...]]:
        """Of words without ASCII white space, as the pre-tokenizer writes them. A word with a special string is one, after a
        mark that no pre-token has."""
        t, new = self.tokenizer, [w for w in words if w not in self.known]
        made = {}
        letters = [w for w in new if w.isascii() and w.isalpha()]
        if letters:  # one pre-token each, if there are as many as words
            got = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(" ".join(letters)))
            if len(got) == len(letters):
                made = {w: (p,) for w, (p, _) in zip(letters, got)}
        for w in new:
            if w not in made:
                if any(s in w for s in self.special):
                    made[w] = (" " + w,)
                else:
                    made[w] = tuple(p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(w))) if w else ()
        out = [self.known[w] if w in self.known else made[w] for w in words]
        if len(self.known) + len(made) > self.most:
            self.known.clear()
        self.known.update((w, p) for w, p in made.items() if len(w) <= 64)
        return out

    def n_pieces(self, pre_token: str) -> int:
        if pre_token.startswith(" "):
            return len(self.tokenizer.encode(pre_token[1:], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(pre_token))

    def slice(self, texts: list[str]):
        """(distinct pre-tokens, matrix as bounds by text, places of pre-tokens and their numbers)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.values.dictionary_encode()
        words, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        pieces: dict[str, int] = {}
        parts = [[pieces.setdefault(p, len(pieces)) for p in own] for own in self.pre_tokens(words)]
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.array([i for p in parts for i in p], np.int64)
        lens, starts = sizes[code], (np.cumsum(sizes) - sizes)[code] if len(words) else np.zeros(0, np.int64)
        ends = np.cumsum(lens)
        at = flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        cells, times = np.unique(text * max(1, len(pieces)) + at, return_counts=True)
        rows = cells // max(1, len(pieces))
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        return list(pieces), bounds, cells - rows * max(1, len(pieces)), times


def packed(bounds, cols, times) -> bytes:
    """A matrix by rows: lengths of rows, steps between columns and times, the bytes of one significance together, compressed."""
    import numpy as np
    import pyarrow as pa

    sizes = np.diff(bounds)
    steps = np.diff(cols, prepend=0)
    first = bounds[:-1][sizes > 0]
    steps[first] = cols[first]
    data = np.concatenate((sizes, steps, times)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.array([len(sizes), len(cols)], "<u4").tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list:
    """(bounds, cols, times) of packed()."""
    import numpy as np
    import pyarrow as pa

    rows, cells = np.frombuffer(data[:8], "<u4").tolist()
    plain = np.frombuffer(pa.decompress(data[8:], 4 * (rows + 2 * cells), codec="zstd", asbytes=True), np.uint8)
    sizes, steps, times = np.split(plain.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64), [rows, rows + cells])
    bounds, total = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(steps)))
    return [bounds, total[1:] - np.repeat(total[bounds[:-1]], sizes), times]


def slices(docs: DataFrame, tokenizer: str, slice_chars: int = 8_000_000) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        own, at, held, size = parts_of(tokenizer), TaskContext.get().partitionId() << 32, [], 0

        def full():
            nonlocal at, held, size
            part = pa.Table.from_batches(held).combine_chunks()
            pieces, *matrix = own.slice(part.column("text").to_pylist())
            values = [at, part.column("doc_id").to_pylist(), pc.binary_length(part.column("text")).to_pylist(), pieces, packed(*matrix)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
            at, held, size = at + 1, [], 0
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=["slice", "doc_ids", "n_bytes", "pieces", "matrix"])

        for b in batches:
            start = 0
            for i, n in enumerate(pc.utf8_length(b.column("text")).to_pylist()):
                size += n
                if size >= slice_chars:
                    held.append(b.slice(start, i + 1 - start))
                    start = i + 1
                    yield full()
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield full()

    return narrow(docs, "text").mapInArrow(run, SLICES)


def count_pieces(named: DataFrame, tokenizer: str) -> DataFrame:
    """named: piece, slice, place. slice, place and n, the piece's number of tokens; each distinct piece is counted once, as rows are sorted by it."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own, last, n = parts_of(tokenizer), None, 0
        for b in batches:
            numbered = b.column("piece").dictionary_encode()
            worth = []
            for p in numbered.dictionary.to_pylist():
                if p != last:
                    last, n = p, own.n_pieces(p)
                worth.append(n)
            yield pa.record_batch([b.column("slice"), b.column("place"), pc.take(pa.array(worth, pa.int32()), numbered.indices)], names=["slice", "place", "n"])

    dealt = named.repartition("piece").sortWithinPartitions("piece")
    return dealt.mapInArrow(run, "slice long, place int, n int")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, slice_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than limit) of each document."""
    held = materialize(slices(docs, tokenizer, slice_chars), "slices")
    counted = count_pieces(held.select("slice", F.posexplode("pieces").alias("place", "piece")), tokenizer)
    gathered = counted.groupBy(F.col("slice").alias("of")).agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))
    whole = held.select("slice", "doc_ids", "n_bytes", "matrix").join(gathered, F.col("slice") == F.col("of"), "left").select("doc_ids", "n_bytes", "matrix", "place", "n")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                ids, size, matrix, place, n = (c[i] for c in b.columns)
                bounds, cols, times = unpacked(matrix.as_py())
                worth = np.zeros(int(cols.max(initial=-1)) + 1, np.int64)
                if place.is_valid:
                    worth[place.values.to_numpy()] = n.values.to_numpy()
                tokens = np.diff(np.concatenate(([0], np.cumsum(worth[cols] * times)))[bounds])
                yield pa.record_batch([ids.values, size.values, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
