"""Operator 8: token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded in one call. A longer one is
cut into chunks that overlap; each is encoded with offsets, and neighbours are
spliced at a border that both encodings share and that is proven stable: no
piece of the vocabulary could lie across it, so no merge ever crosses it in
any context. If an overlap has no such border, it is widened, at last to the
rest of the text. The first chunk keeps its tokens before the border, the next
one those after it.

The vocabulary's normaliser is the identity but for a space put in front and
spaces shown as U+2581, which the proof accounts for. Null text counts as
empty: no bytes, no tokens. Repeated rows give repeated rows, extra columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from media_forecast.shipping import ship_package

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP = 20_000, 256  # bytes
LIMIT = 4096
MARK = "▁"  # how the vocabulary writes a space


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.pieces = {p for p in pieces if len(p) > 1 and not (p.startswith("<0x") and p.endswith(">"))}
        self.longest = max(map(len, self.pieces))

    def stable(self, text: str, at: int) -> bool:
        """No piece of the vocabulary occurs in ``text`` across the border before ``at``."""
        low, high = max(0, at - self.longest + 1), min(len(text), at + self.longest - 1)
        near = text[low:high].replace(" ", MARK)
        at -= low
        for s in range(at):
            for e in range(at + 1, min(len(near), s + self.longest) + 1):
                if near[s:e] in self.pieces:
                    return False
        return True

    def begins(self, raw: bytes, start: int, end: int) -> list[int]:
        """Where the tokens of ``raw[start:end]`` begin, as places in ``raw``.

        All but the first chunk are encoded behind a line break: its byte piece
        keeps the space that the library puts in front away from the chunk. The
        bytes of a sign outside the vocabulary all begin where the sign does.
        """
        if start == 0:
            part, shift = raw[:end], 0
        else:
            part, shift = b"\n" + raw[start:end], start - 1
        got = [p.begin + shift for p in self.model.encode(part.decode("utf-8"), return_type="proto").pieces]
        return got if start == 0 else [x for x in got if x >= start]

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        raw = text.encode("utf-8")
        size = len(raw)

        def sign_at(at: int) -> int:
            while at < size and raw[at] & 0xC0 == 0x80:
                at += 1
            return min(at, size)

        total, start = 0, 0  # start: a stable border up to which tokens are counted
        while True:
            end, wide = sign_at(start + self.chunk), self.overlap
            while True:
                # This chunk reaches over the overlap, the next one begins with it.
                stop = sign_at(end + wide)
                own = self.begins(raw, start, stop)
                if stop == size:
                    return total + len(own)
                shared = set(self.begins(raw, end, stop))
                cut = next((x for x in own if end < x and x in shared and self.stable_bytes(raw, x)), None)
                if cut is not None:
                    break
                wide *= 4
            total += bisect_left(own, cut)
            start = cut

    def stable_bytes(self, raw: bytes, at: int) -> bool:
        reach = 4 * self.longest
        before = raw[max(0, at - reach): at].decode("utf-8", "ignore")
        return self.stable(before + raw[at: at + reach].decode("utf-8", "ignore"), len(before))


_LOADED: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    """The counter, loaded once per worker process."""
    key = (path, chunk, overlap)
    if key not in _LOADED:
        _LOADED[key] = Counter(path, chunk, overlap)
    return _LOADED[key]


def token_counts(
    docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text."""
    ship_package(docs.sparkSession)

    def run(batches):
        c = counter(public_tokenizers.path(model), chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [c.count(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts],
                "n_tokens": n, "over_limit": [x > limit for x in n],
            })

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
