"""SentencePiece BPE with every piece traced back to the bytes of its text.

A text is normalised by the model's compiled character map, a double-array trie of source strings: at each place the
longest source string that begins there is replaced, and where none does, a character stands for itself. Every atom of
the outcome keeps the byte of the text it came from. The normalised text is cut where no piece of the model joins the two
characters, so the parts are encoded on their own: adjacent symbols whose spelling is a piece are joined, best score
first, then leftmost. Sizes of pieces, summed, are places in the normalised text, and its atoms lead these back to
(begin, end) in the bytes of the original one. Decoding reads the spellings of all ids through a table of offsets.

Parts and their pieces are cached, the cache being emptied when full, so that repeated words are cheap.

Cases: a null or empty text has no ids and decodes to the empty text. Very long texts are encoded whole, long parts in
n log n time. Characters without a piece become byte pieces, of which the last holds the character's span and the others
an empty one; in a model without byte pieces a stretch of such characters is one unknown id. A null id is carried along; repeated rows give
repeated results; an empty table gives an empty one. Only the id and text columns are read, so further columns of any
name are ignored. Models that are not BPE, or hold user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from bisect import bisect
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import small_batches
from .common import column

#: Parts of texts that a worker's cache keeps.
CACHE_PARTS = 400_000
#: Parts of more characters than this are joined by a heap.
LONG_PART = 48
#: Parts of up to so many characters are not searched for cuts.
UNCUT = 24
#: Widths of the matrices in which such parts are encoded together.
WIDTHS = (6, 9, 12, 16, UNCUT)
SPACE = "▁"
NEVER, NO_RANK = float("inf"), (1 << 31) - 1
#: Characters of texts that are encoded together.
TOGETHER = 1 << 20
# Fixed values of the model format: kinds of pieces, and the kind of a BPE model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: a length, a double-array trie, and texts that end in a zero."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist() if compiled else []
        self.texts = compiled[4 + size :]
        self._starts: dict[str, bool] = {}
        self.max_key = len(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(bytes of the longest source string that begins at `at`, place of its replacement), or None."""
        units, found = self.units, None
        if not units:
            return None
        place = self._offset(units[0])
        for i in range(at, len(text)):
            place ^= text[i]
            unit = units[place] if place < len(units) else 0x80000000
            if unit & 0x800000FF != text[i]:
                break
            place ^= self._offset(unit)
            if unit & 0x100:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        return found

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]

    def starts(self, character: str) -> bool:
        """Whether some source string begins with this character's bytes."""
        if (known := self._starts.get(character)) is None:
            place, known = (self._offset(self.units[0]) if self.units else 0), bool(self.units)
            for b in character.encode() if known else b"":
                place ^= b
                if place >= len(self.units) or self.units[place] & 0x800000FF != b:
                    known = False
                    break
                place ^= self._offset(self.units[place])
            self._starts[character] = known
        return known


class PieceTables:
    """The tables that a model file implies."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format_

        spec = format_.ModelProto()
        spec.ParseFromString(model)
        trainer, self.rules = spec.trainer_spec, spec.normalizer_spec
        if trainer.model_type != BPE_MODEL or any(p.type in (USER_DEFINED, UNUSED) for p in spec.pieces) or trainer.treat_whitespace_as_suffix or not self.rules.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models of normal, byte and control pieces with escaped, leading spaces are read")
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.byte_ids = [0] * 256
        self.byte_fallback = trainer.byte_fallback
        spelled: list[bytes] = []
        self.leading = np.zeros(len(spec.pieces), bool)
        self.invisible = np.zeros(len(spec.pieces), bool)
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                spelled.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type in (CONTROL, UNKNOWN):
                self.invisible[i] = p.type == CONTROL
                spelled.append(b"" if p.type == CONTROL else trainer.unk_surface.encode())
            else:
                self.leading[i] = p.piece.startswith(SPACE)
                spelled.append(p.piece.replace(SPACE, " ").encode())
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.piece_bytes = np.array([len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.pairs = {p: struct.pack("<2I", i, len(p.encode())) for p, i in self.ids.items()}
        self._merges()
        self.decimal = [str(i) for i in range(len(spec.pieces))]
        # pairs of characters that some piece holds side by side; everywhere else a text may be cut
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inside = set("".join(p for p in self.ids if len(p) > 1))
        alone = "".join(c for c in "\t\n\r" if c not in inside)
        if any(p.rstrip(SPACE) != p and p.strip(SPACE) or SPACE in p.lstrip(SPACE) for p in self.ids):
            self.parts = re.compile(r"[^\0]+|\0+")  # some piece goes on past a space
        else:
            self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _merges(self) -> None:
        """All pairs of pieces that make a piece, by key, with the rank of its score; and the piece of each character."""
        self.of_character = np.full(0x110000, -1, np.int64)
        made = []
        n, ids = len(self.sizes), self.ids
        rank = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_character[ord(piece)] = i
            for k in range(1, len(piece)):
                if piece[:k] in ids and piece[k:] in ids:
                    made.append((ids[piece[:k]] * n + ids[piece[k:]], rank[self.cost[piece]], i))
        made.sort()
        self.pair_keys, self.pair_ranks, self.pair_pieces = (np.array(x, np.int64) for x in zip(*made)) if made else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of pieces, NO_RANK where they make none."""
        key = left.astype(np.int64) * len(self.sizes) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NO_RANK), self.pair_pieces[at]

    def pieces_of_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of parts whose characters are all pieces: the merges of `pieces`, one of every part at a time."""
        size = np.array([len(p) for p in parts], np.int64)
        widest = int(size.max())
        inside = np.arange(widest) < size[:, None]
        symbols = np.full((len(parts), widest), -1, np.int32)
        symbols[inside] = self.of_character[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        ranks = np.full((len(parts), widest), NO_RANK, np.int32)
        if widest > 1:
            ranks[:, :-1] = self.ranked(symbols[:, :-1], symbols[:, 1:])[0]
        done, row = np.full((len(parts), widest), -1, np.int32), np.arange(len(parts))
        while len(row):
            at = ranks.argmin(axis=1)  # of equal ranks the leftmost
            line = np.arange(len(row))
            ready = ranks[line, at] == NO_RANK
            if ready.any():
                done[row[ready], : symbols.shape[1]] = symbols[ready]
                symbols, ranks, row, at = symbols[~ready], ranks[~ready], row[~ready], at[~ready]
                line = np.arange(len(row))
                if not len(row):
                    break
            merged = self.ranked(symbols[line, at], symbols[line, at + 1])[1]
            columns = np.arange(symbols.shape[1] - 1)
            behind = columns[None, :] + (columns[None, :] > at[:, None])  # the symbol behind the merged one is gone
            symbols, ranks = np.take_along_axis(symbols, behind, 1), np.take_along_axis(ranks, behind + (columns[None, :] == at[:, None]), 1)
            symbols[line, at] = merged
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left + 1 < symbols.shape[1]))
                ranks[some, left[some]] = self.ranked(symbols[some, left[some]], symbols[some, left[some] + 1])[0]
            ranks[:, -1] = NO_RANK
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for every byte of its UTF-8, and its end, the byte of the text that it stands for."""
        if not text:
            return "", np.zeros(1, np.int64)
        drop = self.rules.remove_extra_whitespaces
        if not drop and not any(map(self.map.starts, set(text))):
            raw = np.frombuffer(text.encode(), np.uint8)
            origin = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(SPACE.encode()), 1))
            out = text.replace(" ", SPACE)
            if self.rules.add_dummy_prefix:
                out, origin = SPACE + out, np.concatenate([np.zeros(3, np.int64), origin])
            return out, np.append(origin, len(raw))
        source, atoms, origins, at = text.encode(), [], [], 0
        for step in text:  # atoms: what each source string or character becomes, and where it began
            begin = at if not atoms else ends
            width = len(step.encode())
            if at < begin:  # inside the source string that was replaced last
                at += width
                continue
            met = self.map.longest(source, at) if self.map.starts(step) else None
            ends = at + (met[0] if met else width)
            atoms.append(self.map.replacement(met[1]).decode() if met else step)
            origins.append(at)
            at += width
        end = len(source)
        if drop:
            end = self._trim(atoms, origins, end)
        if drop and not atoms:
            return "", np.zeros(1, np.int64)
        if self.rules.add_dummy_prefix:
            atoms.insert(0, " ")
            origins.insert(0, origins[0] if drop else 0)
        atoms = [a.replace(" ", SPACE) for a in atoms]
        return "".join(atoms), np.append(np.repeat(np.array(origins, np.int64), [len(a.encode()) for a in atoms]), end)

    @staticmethod
    def _trim(atoms: list[str], origins: list[int], end: int) -> int:
        """Drop leading and trailing spaces, and all but the first of several; returns the byte where the text then ends."""
        kept, space = [], True
        for a, o in zip(atoms, origins):
            a = a.lstrip(" ") if space else a
            if a:
                kept.append((a, o))
                space = a.endswith(" ")
        while kept and kept[-1][0][-1] in f" {SPACE}":
            a, end = kept.pop()
            if a := a.rstrip(f" {SPACE}"):
                kept.append((a, end))
                break
        atoms[:], origins[:] = [a for a, _ in kept], [o for _, o in kept]
        return end

    def fallback(self, character: str) -> bytes:
        """(id, bytes) pairs of a character that is no piece: its byte pieces, of which the last stands for it, or the unknown id."""
        raw = character.encode()
        ids = [self.byte_ids[b] for b in raw] if self.byte_fallback else [self.unknown]
        return b"".join(struct.pack("<2I", i, len(raw) * (k == len(ids) - 1)) for k, i in enumerate(ids))

    def pieces(self, part: str) -> list[str]:
        """The pieces of a part by joining best pairs first; a single character may be no piece."""
        if len(part) > LONG_PART:
            return self._by_heap(part)
        symbols, cost = list(part), self.cost.get
        costs = [cost(part[i : i + 2], NEVER) for i in range(len(part) - 1)]
        while costs and (best := min(costs)) < NEVER:
            at = costs.index(best)
            piece = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = cost(symbols[at - 1] + piece, NEVER)
            if at < len(costs):
                costs[at] = cost(piece + symbols[at + 1], NEVER)
        return symbols

    def _by_heap(self, part: str) -> list[str]:
        n, cost = len(part), self.cost
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that begins at i: its end, and the one before it
        alive = bytearray(b"\x01") * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (c := cost.get(part[i : end[j]])) is not None:
                heap.append((c, i, j, end[j])) if not started else heapq.heappush(heap, (c, i, j, end[j]))

        started = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and alive[j] and end[i] == j and end[j] == k):
                continue  # one of the two has grown since
            alive[j], end[i] = 0, k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [part[i : end[i]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character are U+FFFD each."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.bytes[at].tobytes()
        skip = 0
        if self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces:
            for i in ids:  # leading control ids are nothing; the first other id loses one space
                if self.invisible[i]:
                    continue
                skip += int(self.leading[i])
                if not (self.rules.remove_extra_whitespaces and self.leading[i] and self.sizes[i] == 1):
                    break
        cuts = [skip, *(c for c in ends[self.invisible[ids]].tolist() if c > skip), len(raw)]  # bytes on both sides of a control id are apart
        return "".join([_text(raw[a:b]) for a, b in zip(cuts, cuts[1:])])


def _text(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


class PieceEncoder(dict):
    """Part of a normalised text to its (id, bytes) pairs as little-endian 32-bit numbers; fills itself."""

    def __init__(self, model: bytes):
        self.tables = PieceTables(model)

    def _short(self, part: str) -> bytes:
        """Pairs of a part that is not cut further."""
        pieces, tables = self.tables.pieces(part), self.tables
        try:
            return b"".join([tables.pairs[p] for p in pieces])
        except KeyError:  # a character that is no piece
            return b"".join([tables.pairs.get(p) or tables.fallback(p) for p in pieces])

    def __missing__(self, part: str) -> bytes:
        if len(part) <= UNCUT:
            found = self._short(part)
        else:
            joined = self.tables.joined
            cuts = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in joined), len(part)]
            found = b"".join([self.get(x) or self._short(x) for x in (part[a:b] for a, b in zip(cuts, cuts[1:]))])
        if len(part) <= 64:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = found
        return found

    def prepare(self, parts: set[str]) -> None:
        """Encode all parts that are not known yet at once, but for long ones and those with characters that are no pieces."""
        new = parts.difference(self)
        if len(self) + len(new) > CACHE_PARTS:
            self.clear()
            new = parts
        known = self.tables.of_character
        new = [p for p in new if len(p) <= UNCUT]
        if not new:
            return
        size = np.array([len(p) for p in new])
        bad = known[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)] < 0
        whole = np.add.reduceat(bad, np.cumsum(size) - size) == 0
        new = [p for p, w in zip(new, whole.tolist()) if w]
        if not new:
            return
        new.sort(key=len)  # parts of like length fill a matrix
        begin = 0
        for width in WIDTHS:
            end = bisect(new, width, key=len)
            if end > begin:
                ids, counts = self.tables.pieces_of_many(new[begin:end])
                raw = np.stack([ids, self.tables.piece_bytes[ids]], axis=1).astype("<u4").tobytes()
                ends = (np.cumsum(counts) * 8).tolist()
                self.update(zip(new[begin:end], [raw[a:b] for a, b in zip([0, *ends], ends)]))
                begin = end

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `encode` gives for each text, TOGETHER characters of them at a time."""
        held, size = [], 0
        for text in chain(texts, [None]):
            if text is not None:
                norm, origin = self.tables.normalised(text)
                held.append((self.tables.parts.findall(norm), origin))
                size += len(text)
            if size > TOGETHER or text is None:
                self.prepare({p for parts, _ in held for p in parts})
                for parts, origin in held:
                    yield self._placed(parts, origin)
                held, size = [], 0

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and (begin, end) of each in the bytes of the text."""
        norm, origin = self.tables.normalised(text)
        return self._placed(self.tables.parts.findall(norm), origin)

    def _placed(self, parts: list[str], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.frombuffer(b"".join(map(self.__getitem__, parts)), "<u4").reshape(-1, 2).astype(np.int64)
        ids, ends = pairs[:, 0], np.cumsum(pairs[:, 1])
        begins = ends - pairs[:, 1]
        if not self.tables.byte_fallback and len(ids):
            unknown = ids == self.tables.unknown
            first = np.append(True, ~(unknown[1:] & unknown[:-1]))
            last = np.append(first[1:], True)
            ids, begins, ends = ids[first], begins[first], ends[last]
        return ids, np.stack([origin[begins], origin[ends]], axis=1)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and model file."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = PieceEncoder(f.read())
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", pieces: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every row; with `pieces` also ids, begins, ends and decoded.

    path: a model file that every executor can read. ids_sha256 is of the decimal ids joined by commas, spans_sha256 of
    begin and end of every piece in turn as little-endian 64-bit integers. A text's ids stay in one row.
    """

    def run(batches):
        code = encoder(path)
        decimal = code.tables.decimal
        for batch in batches:
            counts, digests, decoded_digests, span_digests, lists = [], [], [], [], ([], [], [], [])
            for ids, spans in code.encode_all(x.as_py() or "" for x in batch.column(1)):
                decoded = code.tables.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                span_digests.append(hashlib.sha256(np.ascontiguousarray(spans, "<i8")).hexdigest())
                if pieces:
                    for kept, value in zip(lists, (ids.astype(np.int32), spans[:, 0], spans[:, 1], decoded)):
                        kept.append(value)
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(d, pa.string()) for d in (digests, decoded_digests, span_digests))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
            if pieces:
                columns += [pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int64())), pa.array(lists[2], pa.list_(pa.int64())), pa.array(lists[3], pa.string())]
                names += ["ids", "begins", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>, begins array<bigint>, ends array<bigint>, decoded string" * pieces
    return docs.select(column(docs, doc_id), column(docs, text)).mapInArrow(run, schema)
