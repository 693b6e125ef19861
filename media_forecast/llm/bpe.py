"""Operator 3: byte-pair encoding by backtracking over Aho-Corasick matches.

The merge list is turned into three tables: the longest matches that start at
each place of a word (Aho-Corasick), for every token its longest proper prefix
that is a token, and a pair check. Two adjacent tokens are compatible if no
merge of lower rank would have joined symbols across their border. Greedy
longest matches that back off to shorter ones on an incompatible border give
exactly the ids that merging in rank order gives, in time linear in the word.
Decoding slices one text buffer by an offset table; the texts of all ids of a
document, and their decimal forms, are taken from such tables at once.

Text rules of the vocabulary file (word ends, lower case, white space dropped):
NFC, lower case by code point, words split at white space and by letter runs,
single digits and runs of other signs (beyond ASCII by the library's character
tables, so that every code point is taken as it takes it); bytes stand as printable signs; the
last sign of a word carries the word-end mark. The strings of special tokens
are recognised in the raw text, as the tokenizer's default does.

Null text counts as empty: no ids, empty decoded text. Repeated rows give
repeated rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from media_forecast.llm.common import kept_by_worker
from media_forecast.shipping import ship_package

VOCAB = "word_bpe_49k.json"
CACHE_WORDS = 600_000  # words remembered by a worker; memory bound only
CACHE_PIECES, CACHED_LENGTH = 200_000, 64  # their lower-case pieces, and the signs of a word or piece that is remembered
SEARCHED_PIECES = 600_000  # the search takes longer than the library's model: three times as many of its results are remembered
WINDOW = 512  # signs of a long word that are matched again at a time, so that its time stays linear
# The split pattern and the white space of the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = regex.compile(PIECES)
# Letters, digits, lower case and compositions differ between versions of Unicode: beyond ASCII they are the library's own.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
ANY_PIECES = pre_tokenizers.Split(Regex(PIECES), "removed", invert=True)
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPACES = re.compile(f"[{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # split by str.split, but no white space here
WORD_END = "</w>"


def byte_signs() -> list[str]:
    """Printable sign of each byte: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class Remembered(dict):
    """Values of ``make(key)``, kept up to a memory bound and then forgotten at once."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = got
        return got


class Vocabulary:
    """Merge tables of a word-end BPE vocabulary, with an encoder and a decoder.

    Without text (ids alone, for packing) the pieces go to the library's own
    merge model, which takes less than half the time for pieces met for the first time.
    """

    def __init__(self, path: str, with_text: bool = True):
        self.with_text = with_text
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        # Offset table for decoding.
        texts = [names[i] for i in range(max(names) + 1)]
        self.buffer = "".join(texts)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        # The same as bytes with a space before each, and the decimal ids likewise.
        self.spaced_texts = pa.array([f" {t}".encode() for t in texts], pa.large_binary())
        self.spaced_ids = pa.array([b" %d" % i for i in range(len(texts))], pa.large_binary())
        # Inner alphabet: one character per base symbol, the word-end form of byte b is b + 256.
        self.signs = byte_signs()
        self.sign_table = dict(enumerate(self.signs))
        self.model = None if with_text else Tokenizer.from_file(path).model
        at = {s: i for i, s in enumerate(self.signs)}

        def inner(s: str) -> str:
            end = s.endswith(WORD_END) and s != WORD_END
            codes = [at[c] for c in (s[: -len(WORD_END)] if end else s)]
            if end:
                codes[-1] += 256
            return "".join(map(chr, codes))

        word_of = {i: inner(s) for s, i in vocab.items()}
        id_of = {w: i for i, w in word_of.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.joined[x, y] = z
            self.left[z], self.right[z], self.rank[z] = x, y, r
        self.id_of, self.length = id_of, [0] * len(texts)
        self.longest = max(map(len, id_of))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matcher = ahocorasick.Automaton()
        for w, i in id_of.items():
            self.matcher.add_word(w, i)
        self.matcher.make_automaton()
        # Longest proper prefix that is a token.
        self.shorter: list[int | None] = [None] * len(texts)
        for i, w in word_of.items():
            self.length[i] = len(w)
            for n in range(len(w) - 1, 0, -1):
                if (j := id_of.get(w[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.raw_pieces = Remembered(self._raw_piece, SEARCHED_PIECES if self.model is None else CACHE_PIECES)
        self.raw_words = Remembered(self._raw_word)

    def compatible(self, x: int, y: int) -> bool:
        """Whether tokens x, y stay apart when the text of both is merged in rank order."""
        got = self.pairs.get((x, y))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[x, y] = self._compatible(x, y)
        return got

    def _compatible(self, x: int, y: int) -> bool:
        # Undo the merges of both tokens from the last on. At each state the two
        # symbols at the border must not have a merge that comes before the one undone last;
        # on the left a tie goes to the merge further left.
        rank, far = self.rank, len(self.rank)
        limit, left_first = far, False
        while True:
            z = self.joined.get((x, y))
            if z is not None and (rank[z] < limit or rank[z] == limit and left_first):
                return False
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            # The merge made last is the one of higher rank; of equal ones the right one.
            if rx > ry:
                limit, left_first = rx, False
                x = self.right[x]
            else:
                limit, left_first = ry, True
                y = self.left[y]

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word in the inner alphabet: greedy longest matches, backtracking from the first bad border."""
        pairs, compatible = self.pairs, self.compatible
        ids = [i for _, i in self.matcher.iter_long(word)]
        before = ids[0]
        for k in range(1, len(ids)):
            token = ids[k]
            ok = pairs.get((before, token))
            if not (compatible(before, token) if ok is None else ok):
                return self._backtrack(word, ids[:k], token)
            before = token
        return ids

    def _backtrack(self, word: str, ids: list[int], token: int) -> list[int]:
        """Goes on from ids, a compatible run of longest matches; token is the next longest match, which does not fit."""
        n, length, shorter, iter_long = len(word), self.length, self.shorter, self.matcher.iter_long
        pairs, compatible = self.pairs, self.compatible
        dead: set[int] = set()  # places proven to lead nowhere
        pos = sum([length[i] for i in ids])
        before = ids[-1]
        while True:
            # The token at this place does not fit: a shorter one is tried.
            token = shorter[token]
            while token is None:
                # Nothing shorter starts here: the place is dead, take back the token before.
                dead.add(pos)
                token = ids.pop()
                pos -= length[token]
                before = ids[-1] if ids else None
                token = shorter[token]
            end = pos + length[token]
            if end in dead:
                continue
            if before is not None:
                ok = pairs.get((before, token))
                if not (compatible(before, token) if ok is None else ok):
                    continue
            ids.append(token)
            pos, before = end, token
            # Longest matches again from here, up to one that does not fit. A window does not tell the longest match near its end.
            fits = True
            while fits and pos < n:
                known = n if pos + WINDOW >= n else pos + WINDOW - self.longest
                for _, token in iter_long(word[pos: pos + WINDOW]):
                    if pos > known:
                        break
                    end = pos + length[token]
                    fits = end not in dead
                    if fits:
                        fits = pairs.get((before, token))
                        if fits is None:
                            fits = compatible(before, token)
                    if not fits:
                        break
                    ids.append(token)
                    pos, before = end, token
            if fits:
                return ids

    def _whole(self, i: int) -> bool:
        """A token is the encoding of its own text if its two parts are, and merge last."""
        key = (i, -1)
        got = self.pairs.get(key)
        if got is None:
            if i not in self.left:
                got = True
            else:
                x, y = self.left[i], self.right[i]
                z = self.joined.pop((x, y))
                try:
                    got = self._whole(x) and self._whole(y) and self._compatible(x, y)
                finally:
                    self.joined[x, y] = z
            self.pairs[key] = got
        return got

    @staticmethod
    def _split(word: str) -> tuple[str, ...] | list[str]:
        """The lower-case pieces of one white-space-free word."""
        ascii_only = word.isascii()
        low = word.lower() if ascii_only else NORMAL.normalize_str(word)
        # The usual words need no pattern: letters only, or letters and one sign behind them.
        if low.isalpha():
            return (low,)
        if low[-1:] in (",", ".") and low[:-1].isalpha():
            return (low[:-1], low[-1])
        return ASCII_PIECES.findall(low) if ascii_only else [piece for piece, _ in ANY_PIECES.pre_tokenize_str(low)]

    def _encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        return self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))

    def _raw_piece(self, piece: str) -> bytes:
        if self.model is None:
            ids = self._encode_piece(piece)
        else:
            # Printable ASCII stands for itself, control characters and other bytes for their signs.
            signs = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.sign_table)
            ids = [t.id for t in self.model.tokenize(signs)]
        return pack(f"<{len(ids)}I", *ids)

    def _raw_word(self, word: str) -> bytes:
        found = self._split(word)
        return self.raw_pieces[found[0]] if len(found) == 1 else b"".join([self.raw_pieces[p] for p in found])

    def _raw_parts(self, text: str) -> list[bytes]:
        """The id bytes of the words and special tokens of any text, in text order."""
        out: list[bytes] = []
        for k, run in enumerate(self.special_re.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(pack("<I", self.special[run]))
            else:
                out += [self.raw_words[w] for w in (SPACES.split(run) if ODD_SPACE.search(run) else run.split()) if w]
        return out

    def parts(self, text: str | None) -> list[tuple]:
        """Per word with ids: (id bytes, decimal ids, decoded text), in text order."""
        out: list[tuple] = []
        for raw in self._raw_parts(text or ""):
            if raw:
                ids = np.frombuffer(raw, "<u4").tolist()
                out.append((raw, " ".join(map(str, ids)), self.decode(ids)))
        return out

    def id_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian uint32."""
        if not text:
            return b""
        if "<|" not in text and not ODD_SPACE.search(text):
            return b"".join(map(self.raw_words.__getitem__, text.split()))
        return b"".join(self._raw_parts(text))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.id_bytes(text), "<u4")

    def written(self, ids: np.ndarray) -> tuple[memoryview, memoryview]:
        """The decimal ids and the decoded text, each joined by one space, as UTF-8."""
        at = pa.array(ids)
        return _joined(self.spaced_ids.take(at)), _joined(self.spaced_texts.take(at))

    def decode(self, ids) -> str:
        buf, off = self.buffer, self.offsets
        return " ".join([buf[off[i]: off[i + 1]] for i in ids])


def _joined(spaced: pa.LargeBinaryArray) -> memoryview:
    """The items one behind another, as they lie in the array's buffer, without the first one's space."""
    _, offsets, data = spaced.buffers()
    ends = np.frombuffer(offsets, "<i8")[spaced.offset: spaced.offset + len(spaced) + 1]
    return memoryview(data)[ends[0] + 1: ends[-1]] if len(spaced) else memoryview(b"")


def vocabulary(path: str, with_text: bool = True) -> Vocabulary:
    """The vocabulary, loaded once per worker process."""
    return kept_by_worker("bpe", (path, with_text), lambda: Vocabulary(path, with_text))


def digests(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text."""
    ship_package(docs.sparkSession)

    def run(batches):
        v = vocabulary(public_tokenizers.path(vocab))
        for b in batches:
            n, ids, dec = [], [], []
            for t in b["text"]:
                found = v.encode(t)
                decimal, decoded = v.written(found)
                n.append(len(found))
                ids.append(hashlib.sha256(decimal).hexdigest())
                dec.append(hashlib.sha256(decoded).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": dec})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
