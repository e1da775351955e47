"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (op6)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kadastra.llm.common import table

#: Texts are encoded in groups of so many bytes (a longer one alone), so memory holds one group.
GROUP = 1 << 21
#: Pre-tokens of up to so many bytes share one list and one queue; a longer one has the queue for itself.
SHORT = 64
#: A bucket with fewer positions is merged one by one, a fuller one as arrays.
FEW = 12


class RankQueue:
    """Pairs waiting to be merged, least rank first, leftmost first within a rank.

    A bucket per rank holds list positions. Which buckets hold any is a bitmap of 64-bit
    words under a summary bitmap of the words that aren't zero; the next rank is found by two
    find-first-set steps. Entries are never removed when a merge makes them out of date:
    who pops them checks and skips.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * (ranks // 64 + 1)
        self.summary = 0

    def push(self, rank: int, at: int) -> None:
        if not (bucket := self.buckets[rank]):
            self.words[rank >> 6] |= 1 << (rank & 63)
            self.summary |= 1 << (rank >> 6)
        heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        s = self.summary
        w = (s & -s).bit_length() - 1
        bits = self.words[w]
        rank = (w << 6) | ((bits & -bits).bit_length() - 1)
        at = heappop(bucket := self.buckets[rank])
        if not bucket:
            self.words[w] = bits = bits & (bits - 1)
            if not bits:
                self.summary = s & (s - 1)
        return rank, at

    def fill(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Puts at[i] into the bucket of ranks[i] of an empty queue, whole buckets at a time."""
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)])
        for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
            self.buckets[rank] = at[a:b].tolist()
            self.words[rank >> 6] |= 1 << (rank & 63)
            self.summary |= 1 << (rank >> 6)

    def add(self, rank: int, at: int) -> None:
        """Like `push`, for buckets that are taken whole and so need no order."""
        if not (bucket := self.buckets[rank]):
            self.words[rank >> 6] |= 1 << (rank & 63)
            self.summary |= 1 << (rank >> 6)
        bucket.append(at)

    def take(self) -> tuple[int, list[int]]:
        """The least rank and its whole bucket in order."""
        s = self.summary
        w = (s & -s).bit_length() - 1
        bits = self.words[w]
        rank = (w << 6) | ((bits & -bits).bit_length() - 1)
        self.words[w] = bits = bits & (bits - 1)
        if not bits:
            self.summary = s & (s - 1)
        bucket, self.buckets[rank] = self.buckets[rank], []
        bucket.sort()
        return rank, bucket


class BytePairs:
    """A vocabulary of byte strings by rank, which are their ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i).encode() for i in range(size)]
        # \s of the rank files' own library is Unicode's White_Space
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.queue = RankQueue(size)
        # ids that make a pair: (left * step + right) to the pair's rank; the id `size` stands beyond either end of a list
        self.step = size + 1
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (x := self.ranks.get(token[:cut])) is not None and (y := self.ranks.get(token[cut:])) is not None:
                    self.pairs[x * self.step + y] = rank
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ids, -1 where they make none."""
        key = left * self.step + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has).

        The pieces lie end to end in one linked list, no pair reaching from one to the next, under one
        queue. The bucket of the least rank is taken whole and the leftmost position of every piece
        merged; a piece's other positions go back, as its merge may have made a pair of lesser
        rank. So each piece sees the order of merges that it would see alone.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        n, end = int(sizes.sum()), len(self.bytes_of)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ids = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], end)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(sizes) - 1
        after[last], before[last - sizes + 1] = n, n
        due = self._pair_rank(ids, np.append(ids[1:], end))
        due[last] = -1
        alive = np.ones(n + 1, bool)
        queue, pairs, step = self.queue, self.pairs, self.step
        first = np.flatnonzero(due >= 0)
        if len(first):
            queue.fill(due[first], first)
        at_owner, at_ids, at_after, at_before, at_due, at_alive = map(memoryview, (owner, ids, after, before, due, alive))
        add = queue.add
        while queue.summary:
            r, bucket = queue.take()
            if len(bucket) < FEW:
                seen = -1
                for i in bucket:
                    if at_due[i] != r:
                        continue
                    if (own := at_owner[i]) == seen:
                        add(r, i)
                        continue
                    seen = own
                    j = at_after[i]
                    k, h = at_after[j], at_before[i]
                    at_after[i], at_before[k], at_due[j], at_alive[j], at_ids[i] = k, i, -1, False, r
                    at_due[i] = x = pairs.get(r * step + at_ids[k], -1)
                    if x >= 0:
                        add(x, i)
                    at_due[h] = x = pairs.get(at_ids[h] * step + r, -1)
                    if x >= 0:
                        add(x, h)
                continue
            i = np.array(bucket)
            i = i[due[i] == r]
            own = owner[i]
            lead = np.append(True, own[1:] != own[:-1])[: len(i)]
            for x in i[~lead].tolist():
                add(r, x)
            i = i[lead]
            j = after[i]
            k, h = after[j], before[i]
            after[i], before[k], due[j], alive[j], ids[i] = k, i, -1, False, r
            right, left = self._pair_rank(np.int64(r), ids[k]), self._pair_rank(ids[h], np.int64(r))
            due[i], due[h] = right, left
            for x, y in zip(right.tolist(), i.tolist()):
                if x >= 0:
                    add(x, y)
            for x, y in zip(left.tolist(), h.tolist()):
                if x >= 0:
                    add(x, y)
        alive = alive[:n]
        return ids[:n][alive], np.bincount(owner[alive], minlength=len(pieces))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: always the pair of least rank, leftmost, is merged next."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n, queue = len(piece), self.queue
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        due = [-1] * n  # the rank of the pair that starts here
        push = queue.push
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                due[i] = r
                push(r, i)
        while queue.summary:
            r, i = queue.pop()
            if due[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            due[j] = -1
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : after[k]])) is not None:
                    push(r, i)
                    due[i] = r
                else:
                    due[i] = -1
            else:
                due[i] = -1
            if (h := before[i]) >= 0:
                if (r := ranks.get(piece[h:k])) is not None:
                    if due[h] != r:
                        push(r, h)
                    due[h] = r
                else:
                    due[h] = -1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of different pre-tokens, each through the queue but those that are tokens themselves."""
        found: list = [None] * len(pieces)
        short, at = [], []
        for k, piece in enumerate(map(str.encode, pieces)):
            if (whole := self.ranks.get(piece)) is not None:
                found[k] = (whole,)
            elif len(piece) > SHORT:
                found[k] = self.merge(piece)
            else:
                short.append(piece)
                at.append(k)
        counts = np.array([0 if x is None else len(x) for x in found], np.int64)
        ids = np.empty(0, np.int64)
        if short:
            ids, sizes = self.merge_many(short)
            counts[at] = sizes
        out = np.empty(int(counts.sum()), np.int64)
        merged = np.zeros(len(pieces), bool)
        merged[at] = True
        mask = np.repeat(merged, counts)
        out[mask] = ids
        out[~mask] = np.fromiter(chain.from_iterable(x for x in found if x is not None), np.int64)
        return out, counts

    def encode_many(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last's end); null texts have none.

        Where a single space stands between two characters that are no white space, the pattern always starts a new match with
        that space, whatever stands before or after. There the texts are cut into runs; each
        different run is matched once, each different match merged once.
        """
        texts = texts.fill_null("").cast(pa.string())
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        if not len(texts) or data is None or bounds[0] == bounds[-1]:
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(raw[bounds[0] : bounds[-1]] == 0x20) + bounds[0]
        cuts = cuts[(cuts >= bounds[0] + 3) & (cuts + 1 < bounds[-1])]
        cuts = cuts[_inner(raw, cuts)]
        starts = np.sort(np.concatenate([cuts, bounds[:-1][bounds[1:] > bounds[:-1]]]), kind="stable")
        starts = starts[np.append(True, starts[1:] != starts[:-1])]
        ends = np.append(starts[1:], bounds[-1]).astype(np.int32)
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts[:1], ends).astype(np.int32)), data).dictionary_encode()
        matches = list(map(self.pattern.findall, runs.dictionary.to_pylist()))
        pieces = pa.array(list(chain.from_iterable(matches)), pa.string()).dictionary_encode()
        ids, counts = self._pieces(pieces.dictionary.to_pylist())
        ids, counts = _joined(ids, counts, pieces.indices.to_numpy(), np.fromiter(map(len, matches), np.int64))
        codes = runs.indices.to_numpy()
        ids, counts = _joined(ids, counts, codes, np.diff(np.append(np.searchsorted(starts, bounds[:-1]), len(starts))))
        return ids, np.append(0, np.cumsum(counts))

    def encode(self, text: str) -> list[int]:
        """The ids of `text`, each match of the pattern merged separately."""
        return self.encode_many(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _inner(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether no white space stands beside the spaces at `at`; some other signs beyond ASCII count as such, too."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    lead = np.zeros(256, bool)  # white space beyond ASCII begins with one of these bytes
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    behind = blank[raw[at - 1]] | (raw[at - 2] == 0xC2) | (lead[raw[at - 3]] & (raw[at - 1] >= 0x80))
    return ~(behind | blank[raw[at + 1]] | lead[raw[at + 1]])


def _joined(ids: np.ndarray, counts: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of wholes, whole k made of the next sizes[k] entries of `parts`, from those of the parts."""
    begin = np.cumsum(counts) - counts
    n = counts[parts]
    stop = np.cumsum(n)
    at = np.repeat(begin[parts] - (stop - n), n)
    at += np.arange(len(at))
    whole = np.append(0, stop)[np.append(0, np.cumsum(sizes))]
    return ids[at], np.diff(whole)


def _groups(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """`texts` in slices of at most GROUP bytes; a longer text is a slice of its own."""
    sizes = np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in texts])
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, base + GROUP, "right")))
        yield texts.slice(at, stop - at)
        at = stop


@lru_cache(maxsize=4)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The vocabulary, read once per worker."""
    return BytePairs(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public tokenizer's rank file, where this process runs."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, *, name: str = "byte_bpe_50k.tiktoken", text: str = "text", ids: bool = False) -> DataFrame:
    """`docs` with n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves.

    Null texts count as empty: no tokens, the hashes of nothing. Any other column passes
    unchanged, except those of the names above, which are replaced. No row leaves its
    partition; memory holds one batch of texts and the lists of one group of them.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    kept = docs.drop(*added)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text])
    columns = [f.name for f in kept.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(*vocabulary(name))
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in added}
            for group in _groups(batch.column(batch.schema.get_field_index(text))):
                flat, bounds = bpe.encode_many(group)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    tokens = flat[a:b].tolist()
                    rows["n_tokens"].append(b - a)
                    rows["ids_sha256"].append(hashlib.sha256(b" ".join(map(bpe.text_of.__getitem__, tokens))).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(tokens)).hexdigest())
                    if ids:
                        rows["ids"].append(tokens)
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), *(pa.array(rows[c], types.get(c, pa.string())) for c in added)],
                names=[*columns, *added],
            )

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return kept.mapInArrow(run, f"{schema}, {new}" if schema else new)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
