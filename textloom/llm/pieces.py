"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece that
they would form, and always merges the best pair, the leftmost of equals. Since no piece of
such a vocabulary holds a space mark after another character (checked on loading), texts
fall into segments that cannot merge with each other: a run of space marks with what
follows it. Segments are encoded once each and remembered in a bounded table; those of a
batch that are new run their agendas side by side in NumPy, a merge for each at a time.
Segments beyond ``WIDE`` characters use one agenda in a heap.

Decoding turns pieces into text, byte pieces into bytes, space marks into spaces, and drops
the space that encoding put in front. A part of each Arrow batch is encoded and decoded
with the sentencepiece library as well; a difference stops the job.

Defined results: null and empty texts have no ids and decode to the empty text; the space
mark itself decodes to a space; repeated rows and ids are encoded one by one; an empty
table gives an empty result; texts of any length are encoded whole. Columns of the input pass
through; where one is named ids, n_tokens or decoded, the operator's own gets an underscore
appended.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, free_name, ship

MARK = "▁"
WIDE = 48
#: Segments of up to WIDE characters that a worker remembers in each of two generations; what the older one has and is used again moves up.
REMEMBERED = 200_000
#: Encode and decode each k-th row of a batch with the library too.
AUDIT_EVERY = 32
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The pieces of a model and the merges they allow."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_at) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.as_byte = {i: b for b, i in self.bytes_at.items()}
        self.breaks = not any("\n" in p for p in self.ids)
        self.segments = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
        # symbols: pieces by id, then single characters that occur in pieces without being one
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        self.base = n + 2 * len(self.symbols) + 1
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        keys, rank, made = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    rank.append(rank_of[sp.get_score(i)])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.rank = np.append(np.array(rank, np.int32)[order], _NONE)
        self.made = np.append(np.array(made, np.int32)[order], np.int32(0))
        self.pair = {k: (r, m) for k, r, m in zip(keys, rank, made, strict=True)}
        # a segment's ids, joined by commas; with the decoded text where that is not the segment itself
        self.memory: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.long: dict[str, str | tuple[str, str]] = {}  # segments beyond WIDE, of one run of texts only

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; negative symbols merge with nothing."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def _side_by_side(self, segments: list[str]) -> list[list[int]]:
        """Agendas of segments of about one length, a merge for each at a time. -1: no symbol, below: unknown character."""
        width = max(map(len, segments))
        sym = np.full((len(segments), width + 1), -1, np.int32)
        strange: list[str] = []
        get = self.symbols.get
        for k, s in enumerate(segments):
            row = [get(c) for c in s]
            for j, x in enumerate(row):
                if x is None:
                    strange.append(s[j])
                    row[j] = -1 - len(strange)
            sym[k, : len(row)] = row
        rank, made = self._look(sym[:, :-1], sym[:, 1:])
        live = np.arange(len(segments))
        cols = np.arange(width + 1)
        while True:
            best = rank[live].argmin(axis=1)
            go = rank[live, best] != _NONE
            live, best = live[go], best[go]
            if not len(live):
                break
            new = made[live, best]
            take = np.minimum(cols + (cols > best[:, None]), width)
            s = np.take_along_axis(sym[live], take, 1)
            s[:, -1] = -1
            at = np.arange(len(live))
            s[at, best] = new
            sym[live] = s
            r, m = (np.take_along_axis(x[live], take[:, :-1].clip(max=width - 1), 1) for x in (rank, made))
            r[:, -1] = _NONE
            for j in (best - 1, best):
                ok = (j >= 0) & (j < width)
                jj = j[ok]
                r[at[ok], jj], m[at[ok], jj] = self._look(s[at[ok], jj], s[at[ok], jj + 1])
            rank[live], made[live] = r, m
        out = []
        for row in sym.tolist():
            ids: list[int] = []
            for x in row:
                if x == -1:
                    break
                self._emit(ids, x, strange)
            out.append(ids)
        return out

    def _emit(self, ids: list[int], x: int, strange: list[str]) -> None:
        if 0 <= x < len(self.pieces):
            ids.append(x)
        else:
            c = strange[-2 - x] if x < 0 else self._char(x)
            ids.extend(self.bytes_at[b] for b in c.encode())

    def _char(self, x: int) -> str:
        if not hasattr(self, "chars"):
            self.chars = {v: k for k, v in self.symbols.items() if v >= len(self.pieces)}
        return self.chars[x]

    def _heap(self, segment: str) -> list[int]:
        """One agenda for a long segment: a heap of (rank, left place), stale entries skipped."""
        strange: list[str] = []
        sym = []
        for c in segment:
            x = self.symbols.get(c)
            if x is None:
                strange.append(c)
                x = -1 - len(strange)
            sym.append(x)
        n = len(sym)
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def put(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (got := self.pair.get(sym[i] * self.base + sym[j])):
                heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

        dead = bytearray(n)
        for i in range(n):
            put(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i] = made
            dead[j] = 1
            after[i] = after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            if prev[i] >= 0:
                put(prev[i])
            put(i)
        ids: list[int] = []
        i = 0
        while i >= 0 and n:
            self._emit(ids, sym[i], strange)
            i = after[i]
        return ids

    def decode(self, ids) -> str:
        """Text of ``ids`` with the space in front still there."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.as_byte:
                run.append(self.as_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def learn(self, segments: set[str]) -> None:
        """Puts segments that are not remembered into the table: their ids, joined by commas, and their decoded text."""
        self.long = {}
        if len(self.memory) > REMEMBERED:
            self.older, self.memory = self.memory, {}
        new = segments - self.memory.keys()
        known = new & self.older.keys()
        for s in known:
            self.memory[s] = self.older[s]
        new = sorted(new - known, key=len)
        i = 0
        while i < len(new):
            if len(new[i]) > WIDE:
                some, got = [new[i]], [self._heap(new[i])]
            else:
                some = new[i : i + 4096]
                some = some[: next((k for k, s in enumerate(some) if len(s) > max(WIDE // 4, len(some[0]) + 4)), len(some)) or 1]
                got = self._side_by_side(some)
            for s, ids in zip(some, got, strict=True):
                joined, back = ",".join(map(str, ids)), self.decode(ids)
                (self.long if len(s) > WIDE else self.memory)[s] = joined if back == s.replace(MARK, " ") else (joined, back)
            i += len(some)

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        cut = [self.segments.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        need: set[str] = set()
        for c in cut:
            need.update(c)
        self.learn(need)
        out = []
        for c in cut:
            got = [self.memory[s] if len(s) <= WIDE else self.long[s] for s in c]
            if tuple in set(map(type, got)):
                back = "".join([s.replace(MARK, " ") if isinstance(x, str) else x[1] for s, x in zip(c, got, strict=True)])
                got = [x if isinstance(x, str) else x[0] for x in got]
            else:
                back = "".join(c).replace(MARK, " ")
            out.append((",".join(got), back[1:]))
        return out

    def audit(self, text: str, ids: str, decoded: str) -> None:
        want = self.library.encode(text)
        if ids != ",".join(map(str, want)) or decoded != self.library.decode(want):
            raise ValueError(f"encoding differs from the library's at {text[:80]!r}")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a public tokenizer by name, or of a model file by path; once for each worker."""
    if name not in _loaded:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[name] = Vocabulary(path)
    return _loaded[name]


def encode_documents(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", audit_every: int = AUDIT_EVERY, only: list[str] | None = None) -> DataFrame:
    """Adds ids (text of decimal ids joined by commas), n_tokens (long) and decoded to ``docs``.

    ``only``: of the input's columns, keep these.
    """
    ship(docs.sparkSession)
    keep = docs.columns if only is None else only
    added = [free_name(c, keep) for c in ("ids", "n_tokens", "decoded")]
    picked = docs.select(*[f"`{c}`" for c in keep], *([] if text in keep else [text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in keep), *(f"`{c}` {t}" for c, t in zip(added, ("string", "long", "string"), strict=True))])
    names = [*keep, *added]
    place = picked.columns.index(text)

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            column = b.column(place).cast(pa.large_binary())
            lens = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
            for i, j in chunks([_Sized(n) for n in lens]):
                texts = [(x or b"").decode("utf-8", "replace") for x in column.slice(i, j - i).to_pylist()]
                got = v.encode_all(texts)
                for k in range(0, len(texts), audit_every):
                    v.audit(texts[k], *got[k])
                n = [x[0].count(",") + 1 if x[0] else 0 for x in got]
                cols = [b.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in got], pa.string()), pa.array(n, pa.int64()), pa.array([x[1] for x in got], pa.string())], names=names)

    return picked.mapInArrow(run, schema)


class _Sized:
    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n
