"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs ordered by piece
score, then position, and merges the best pair until none is a piece.  A text
falls apart where no piece of the vocabulary crosses (see ``cutter``); each
segment is merged on its own, and short segments are remembered per
worker process.  Every Arrow batch is held against the sentencepiece library,
and a difference raises: by default the segments that were merged, with
``check="texts"`` (the query) all whole texts, encoded and decoded.

Defined cases: null text counts as empty; an empty text has the end id only
and decodes to "".  Any length is processed whole; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, repeat
from operator import add

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import map_rows, sha_hex, table

MARK = "▁"
CACHE_CHARS = 48          # segments up to this length are remembered
CACHE_ENTRIES = 500_000   # then the segments not met since the last time go (some 250 MB a worker)
SHORT = 48                # segments up to this length keep their agenda as a list
NO_PIECE = math.inf
LINES = 256               # segments in one text of the check


def cutter(pieces) -> re.Pattern | None:
    """Pattern of the segments that no piece crosses; None if a piece holds an inner word mark.

    Cuts are before a word mark, around line breaks, and between a letter or
    digit and a character of ``tail``: no piece holds two such neighbours.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(b == MARK != a or "\n" in (a, b) for a, b in pairs):
        return None
    tail = {c for p in pieces for c in p if c.isascii() and not c.isalnum()} - {b for a, b in pairs if a.isalnum()}
    m = re.escape(MARK)
    words = f"{m}*[^\\W_]++(?=[{re.escape(''.join(sorted(tail)))}])|" if tail else ""
    return re.compile(f"{words}{m}+[^{m}\n]*|[^{m}\n]+|\n")


class Memory:
    """Ids of segments met before; those not met since the memory was last full are forgotten."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def young(self) -> dict[str, tuple[int, ...]]:
        if len(self.new) > CACHE_ENTRIES:
            self.new, self.old = {}, self.new
        return self.new

    def missing(self, keys: list[str]) -> list[str]:
        """Keys not in memory; keys from before are taken over."""
        out = []
        for k in {*keys}.difference(self.new):
            ids = self.old.get(k)
            if ids is None:
                out.append(k)
            else:
                self.new[k] = ids
        return out


class Pieces:
    """Vocabulary of a merge-type model and the agenda over it."""

    def __init__(self, model: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.lib.vocab_size()
        kind = [(self.lib.is_control(i) or self.lib.is_unknown(i), self.lib.is_byte(i)) for i in range(n)]
        names = [self.lib.id_to_piece(i) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if not any(kind[i])}
        self.cost = {names[i]: -self.lib.get_score(i) for i in self.ids.values()}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if kind[i][1]}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        # What an id shows: nothing for control ids, a character for bytes that are one.
        self.high = {i for i, b in self.byte_of.items() if b > 127}
        self.shown = ["" if c else chr(self.byte_of[i]) if b else names[i] for i, (c, b) in enumerate(kind)]
        self.eos = self.lib.eos_id()
        self.cut = cutter(self.ids)
        self.digits = [f" {i}" for i in range(n)]
        self.memory = Memory()                            # ids of segments
        self.lossy = False                                # a segment did not decode to itself
        self.fresh: list[tuple[str, list[int]]] = []      # segments merged since the last check

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda of adjacent pairs."""
        symbols = self.merge_short(segment) if len(segment) <= SHORT else self.merge_long(segment)
        try:
            return list(map(self.ids.__getitem__, symbols))
        except KeyError:                      # a symbol without a piece is written in bytes
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else
                                                 [self.byte_id[x] for x in s.encode("utf-8")])]

    def merge_short(self, segment: str) -> list[str]:
        """The agenda as a list beside the symbols: best score first, then leftmost."""
        sym, get = list(segment), self.cost.get
        agenda = list(map(get, map(add, sym, sym[1:]), repeat(NO_PIECE)))
        while agenda:
            best = min(agenda)
            if best is NO_PIECE:
                break
            i = agenda.index(best)
            sym[i] = both = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = get(sym[i - 1] + both, NO_PIECE)
            if i < len(agenda):
                agenda[i] = get(both + sym[i + 1], NO_PIECE)
        return sym

    def merge_long(self, segment: str) -> list[str]:
        """The agenda as a heap of (cost, left, right, length) with stale entries skipped."""
        sym, cost = list(segment), self.cost
        prev, nxt = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            pair = sym[a] + sym[b]
            if pair in cost:
                heapq.heappush(agenda, (cost[pair], a, b, len(pair)))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or nxt[a] != b or len(sym[a]) + len(sym[b]) != size:
                continue                      # one side has been merged since
            sym[a], sym[b] = sym[a] + sym[b], ""
            nxt[a] = c = nxt[b]
            if c >= 0:
                prev[c] = a
                offer(a, c)
            if prev[a] >= 0:
                offer(prev[a], a)
        return [x for x in sym if x]

    def look_up(self, text: str, note: bool = True) -> tuple[list[int], str]:
        """(ids, decoded text) of a text; ``note`` keeps merged segments for ``check_fresh``."""
        whole = MARK + text.replace(" ", MARK) if text else ""
        parts = self.cut.findall(whole) if self.cut else [whole] * bool(text)
        memory, long = self.memory.young(), []
        for p in self.memory.missing(parts):
            ids = self.merge(p)
            if self.show(ids) != p:
                self.lossy = True
            memory[p] = tuple(ids)
            if len(p) > CACHE_CHARS:
                long.append(p)
            if note:
                self.fresh.append((p, ids))
        got = list(chain.from_iterable(map(memory.__getitem__, parts)))
        for p in long:
            del memory[p]
        # Segments hold whole characters, so where all decode to themselves the text does.
        return got, self.decode(got) if self.lossy else text.replace(MARK, " ")

    def encode(self, text: str) -> list[int]:
        """Ids with the end id, without a begin id."""
        return [*self.look_up(text)[0], self.eos]

    def show(self, ids: Sequence[int]) -> str:
        """Pieces of ids, runs of bytes as UTF-8."""
        if self.high.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.shown[i])
        return "".join([*out, run.decode("utf-8", "replace")])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: word marks become spaces, and the first is dropped."""
        return self.show(ids).removeprefix(MARK).replace(MARK, " ")

    def check_fresh(self) -> None:
        """Hold every segment merged since the last call, and its decoding, against the library.

        The segments are laid out one to a line, so that none meets another.
        """
        if not self.fresh:
            return
        if self.cut is None:                  # whole texts are the segments
            whole = [p.removeprefix(MARK).replace(MARK, " ") for p, _ in self.fresh]
            if self.lib.encode(whole, num_threads=1) != [ids for _, ids in self.fresh]:
                raise ValueError("texts differ from the sentencepiece library")
            self.fresh.clear()
            return
        line, lone = self.byte_id[10], [x for x in self.fresh if "\n" not in x[0]]
        texts, want = [], []
        for lo in range(0, len(lone), LINES):
            part = lone[lo:lo + LINES]
            texts.append("".join(["\n" + p for p, _ in part]).replace(MARK, " "))
            want.append([self.ids[MARK], *chain.from_iterable((line, *ids) for _, ids in part)])
        if lone and (self.lib.encode(texts, num_threads=1) != want
                     or self.lib.decode(want, num_threads=1) != [self.decode(x) for x in want]):
            raise ValueError("segments differ from the sentencepiece library")
        self.fresh.clear()


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """The vocabulary with its remembered segments, once per worker process."""
    return Pieces(model)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(df: DataFrame, id_col: str, text_col: str, model: str, *, with_ids: bool = False,
                 check: str = "segments") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` (and ``ids, decoded``) for every row.

    ``check`` says what each batch holds against the library: every segment
    it had to merge, or its whole texts (``texts``).
    """

    def make():
        p = pieces(model)

        def run(rows):
            texts = [t or "" for _, t in rows]
            got = [p.look_up(t, check != "texts") for t in texts]
            for ids, _ in got:
                ids.append(p.eos)
            if check == "texts":
                ids = [x for x, _ in got]
                if ids != p.lib.encode(texts, add_eos=True, num_threads=1):
                    raise ValueError("ids differ from the sentencepiece library")
                if [d for _, d in got] != p.lib.decode(ids, num_threads=1):
                    raise ValueError("decoded text differs from the sentencepiece library")
            p.check_fresh()
            for (key, _), (ids, d) in zip(rows, got, strict=True):
                out = (key, len(ids), sha_hex("".join(map(p.digits.__getitem__, ids))[1:]), sha_hex(d))
                yield (*out, ids, d) if with_ids else out
        return run

    key = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.select(id_col, text_col), make, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", default_model(), check="texts")
