"""Exact BPE by backtracking over longest matches.

An Aho-Corasick automaton finds the longest token that starts at each symbol of a word. Tokens are laid down
greedily; a token may follow another only if the pair is compatible, that is, if merging the two spellings in rank
order would keep them apart. When no token fits, the last one is taken back and shortened. Positions that once
failed are marked, so the work is linear in the word for a fixed vocabulary. The result is the one that merges
applied in rank order give.

Text is cut into words by the normalizer and pre-tokenizer of the vocabulary file. A cache from a word to its ids,
emptied when full, makes repeated words cheap; the file's rules never join pieces across a space. Decoding reads the bytes of all tokens, each with its separator, through a table of offsets.

Cases: a null or empty text has no tokens and decodes to the empty text. Very long texts and words are encoded whole.
Special marks are tokens however often they occur. A null id is carried along; repeated rows give repeated results; an empty table gives an empty one. Only the id and text columns are read, so
further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import small_batches

#: Words kept by a worker's cache.
CACHE_WORDS = 200_000
#: Decisions on pairs of tokens that it keeps.
PAIRS = 250_000
#: Code points under this are Latin letters and marks, whose lower case and classes no Unicode version changes.
LATIN = 0x180
BEYOND = re.compile(r"[\u0130\u0180-\U0010ffff]")
#: Added to a code point to mark the last symbol of a word.
LAST = 0x1000
WORD_END = "</w>"


class BpeTables:
    """The tables that a vocabulary file implies."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.pre_tokenize = (library.pre_tokenizer or pre_tokenizers.Sequence([])).pre_tokenize_str
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut_marks = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.special else lambda piece: [piece]
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            joined = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = rank
            self.split.setdefault(joined, (vocab[left], vocab[right], rank))
        spelled = {self._symbols(s): i for s, i in vocab.items()}
        self._compatible: dict[tuple[int, int], bool] = {}
        usable = {i for i in spelled.values() if i not in self.split or self._stands(i)}
        self.length = {i: len(s) for s, i in spelled.items()}
        self.by_spelling = {s: i for s, i in spelled.items() if i in usable}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_spelling.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, i in self.by_spelling.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.by_spelling.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self._offsets(vocab)

    @staticmethod
    def _symbols(token: str) -> str:
        if len(token) > len(WORD_END) and token.endswith(WORD_END):
            token = token[: -len(WORD_END)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def _offsets(self, vocab: dict[str, int]) -> None:
        """Bytes of all tokens by id, each with a space behind it, and where each begins."""
        words = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        parts = [(words.get(i, "") + " ").encode() for i in range(max(words) + 1)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_sizes = np.array([len(p) for p in parts], np.int64)
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_sizes)[:-1]])

    def _apart(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of rank under `below` crosses the border between two tokens.

        Walks back through time: whichever of the two was made last is undone to its half at the border. A border
        pair that exists between ranks lo and hi would be merged if its rank lies there.
        """
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < below:
                return False
            made_left = self.split[left][2] if left in self.split else -1
            made_right = self.split[right][2] if right in self.split else -1
            if made_left < 0 and made_right < 0:
                return True
            # The left of two merges of one rank comes first, so a border pair of the right token's own rank waits.
            if made_left > made_right:
                below, left = min(below, made_left), self.split[left][1]
            else:
                below, right = min(below, made_right + 1), self.split[right][0]

    def _stands(self, token: int) -> bool:
        left, right, rank = self.split[token]
        return self._apart(left, right, rank)

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        if (known := self._compatible.get(key)) is None:
            if len(self._compatible) > PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._apart(left, right, 1 << 60)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, in the byte alphabet of the file."""
        word = word[:-1] + chr(ord(word[-1]) + LAST)
        if (whole := self.by_spelling.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(word):  # of one start, the longest ends last
            longest[end + 1 - size] = token
        open_end = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        length, known = self.length, self._compatible
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_end[end]:
                    fits = True if last < 0 else known.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = self.shorter.get(token, -1)
            if token >= 0:
                ids.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                open_end[at] = 0
                token = ids.pop()
                at -= length[token]
                last = ids[-1] if ids else -1
                token = self.shorter.get(token, -1)
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece of text that holds no space or newline."""
        ids: list[int] = []
        for part in self.cut_marks(piece):
            if (mark := self.special.get(part)) is not None:
                ids.append(mark)
            elif part:
                for word, _ in self.pre_tokenize(self.normalize(part)):
                    ids += self.encode_word(word)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        if not len(ids):
            return b""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.token_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.token_bytes[at][:-1].tobytes()


def latin_words() -> re.Pattern:
    """The pre-tokenizer's pattern for text whose code points lie under LATIN, as character classes of that range."""
    kinds: dict[str, str] = {"L": "", "N": "", "S": r"\t\n\v\f\r \x85\xa0"}
    for c in map(chr, range(LATIN)):
        if (kind := unicodedata.category(c)[0]) in "LN":
            kinds[kind] += c
    return re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(**kinds))


class Encoder(dict):
    """Pre-token to the little-endian 32-bit ids of its tokens; fills itself.

    Text in the Latin blocks is normalized and cut here, other pieces by the library's own rules, which are slower.
    """

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.words = latin_words().findall
        self.bytes_to_chars = {b: c for b, c in _byte_alphabet().items()}
        self.other: dict[str, bytes] = {}
        self.marks = tuple(tables.special)

    def __missing__(self, word: str) -> bytes:
        ids = self.tables.encode_word(word.encode().decode("latin-1").translate(self.bytes_to_chars))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if (found := self.other.get(piece)) is None:
            ids = self.tables.encode_piece(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.other) >= CACHE_WORDS // 4:
                    self.other.clear()
                self.other[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if (text.isascii() or not BEYOND.search(text)) and not any(m in text for m in self.marks):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return b"".join(map(self.__getitem__, self.words(text.lower())))
        return b"".join(map(self._piece, text.replace("\n", " ").split(" ")))


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(BpeTables(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with `texts` also ids and decoded themselves.

    path: a vocabulary file that every executor can read. A text's ids stay in one row.
    """

    def run(batches):
        code = encoder(path)
        for batch in batches:
            counts, digests, decoded_digests, all_ids, all_texts = [], [], [], [], []
            for x in batch.column(1):
                raw = code.encode(x.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                decoded = code.tables.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded).hexdigest())
                if texts:
                    all_ids.append(ids.astype(np.int32))
                    all_texts.append(decoded.decode("utf-8"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return docs.select(doc_id, text).mapInArrow(run, schema)
