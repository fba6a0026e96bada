"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The last token of a BPE encoding of a prefix is the one token that ends there and stands next to
the last token of what comes before it without being merged with it. So an encoder can go byte by
byte. Its state is the last token that is settled and the bytes after it. A place is alive while
the bytes from it on may still begin a longer token; a token is emitted as soon as the paths to all
places that are alive agree on it, which is after less than the longest token's bytes. States and
steps are made when a text first needs them. Once there are as many as a worker may keep, a piece that
leaves the known steps goes on from its state through steps that are worked out and not kept.
"""

from __future__ import annotations

import base64
import gc
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What splits text before the merges; a parameter of every public function.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of what a worker remembers: steps of the transducer, and whole pieces with their tokens.
MOST_STEPS, MOST_WORDS, MOST_PAIRS, LONGEST_WORD = 200_000, 900_000, 400_000, 64


def load_ranks(vocabulary: str) -> dict[bytes, int]:
    """Token bytes to rank; ``vocabulary`` is a path, or the name of a file of public_tokenizers."""
    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Memo(dict):
    """Pieces of text to the bytes of their ids; what is missing comes from the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.pop(word, None)
        if found is None:
            found = array("i", self.machine.piece(word.encode())).tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS // 2:
                # What was not asked for since the last time goes; the rest is the older half now.
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Transducer:
    """Encodes one piece of text at a time; ``encode`` on whole texts splits them first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begins = {b[:k] for b in ranks for k in range(1, len(b))}
        self.split = regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        #: Tokens that merges do make of their own bytes; others never occur.
        self.tokens = {b: i for b, i in ranks.items() if self.merge(b) == [i]}
        #: Beginnings of tokens and tokens: the id of a token that occurs, else -1.
        self.nodes = dict.fromkeys(self.begins, -1) | self.tokens
        self.pairs: dict[int, bool] = {}
        self.words = _Memo(self)
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.data: list[tuple[bytes, list[int | None]]] = [(b"", [-1])]
        self.last: list[list[int]] = [[]]
        self.steps: dict[int, tuple[int, list[int]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Reference merges of a short piece: the lowest-ranked pair first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _apart(self, a: int, b: int) -> bool:
        """May token b follow token a in an encoding?"""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _end(self, held: bytes, ends: list[int | None], n: int) -> int | None:
        """The last token of the encoding of ``held[:n]``, given those of its beginnings."""
        tokens = self.tokens
        for j in range(max(0, n - self.longest), n):
            before = ends[j]
            if before is not None and (t := tokens.get(held[j:n])) is not None and (before < 0 or self._apart(before, t)):
                return t
        return None

    def _chain(self, ends: list[int], at: int) -> list[int]:
        """Places passed on the way back from ``at`` to the settled one, last first."""
        out = [at]
        while at:
            at -= len(self.bytes_of[ends[at]])
            out.append(at)
        return out

    def step(self, state: int, byte: int) -> tuple[int, list[int]]:
        """Make the step of ``state`` on ``byte``: the next state and the tokens emitted."""
        held, ends = self.data[state]
        held, n = held + bytes([byte]), len(held) + 1
        ends = [*ends, self._end(held, ends, n)]
        alive = [j for j in range(n) if ends[j] is not None and held[j:] in self.begins] + [n]
        chains = [self._chain(ends, j) for j in alive]
        common = max(set(chains[0]).intersection(*chains[1:]))
        out: list[int] = []
        for place in self._chain(ends, common)[:-1]:
            out.append(ends[place])
        out.reverse()
        used = {p for c in chains for p in c}
        kept = [ends[p] if p in used else None for p in range(common, n + 1)]
        key = (kept[0], held[common:])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.data)
            self.data.append((key[1], kept))
            self.last.append([kept[p] for p in self._chain(kept, len(kept) - 1)[:-1]][::-1])
        self.steps[state << 8 | byte] = found = (to, out)
        return found

    def _rest(self, state: int, rest: bytes) -> list[int]:
        """What is still to emit in ``state`` if ``rest`` ends the piece; no step is kept.

        From the settled token on, the longest token that may stand there is tried first. Only one
        path of tokens that may stand next to each other leads through a place, so a place that leads
        nowhere is never tried again.
        """
        held, ends = self.data[state]
        text, nodes, pairs = held + rest, self.nodes, self.pairs
        n, at, before, out, path, dead = len(text), 0, ends[0], [], [], set()
        found: list[tuple[int, int]] | None = None
        while at < n:
            if found is None:
                found, stop = [], at + 1
                while stop <= n and (t := nodes.get(text[at:stop])) is not None:
                    if t >= 0:
                        found.append((stop, t))
                    stop += 1
            while found:
                stop, t = found.pop()
                if stop not in dead:
                    if before < 0:
                        break
                    ok = pairs.get(before << 20 | t)
                    if ok or (ok is None and self._apart(before, t)):
                        break
            else:
                dead.add(at)
                at, before, found = path.pop()
                out.pop()
                continue
            path.append((at, before, found))
            out.append(t)
            at, before, found = stop, t, None
        return out

    def piece(self, piece: bytes) -> list[int]:
        state, out, steps = 0, [], self.steps
        for k, byte in enumerate(piece):
            found = steps.get(state << 8 | byte)
            if found is None:
                if len(steps) >= MOST_STEPS:
                    return out + self._rest(state, piece[k:])
                found = self.step(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        return out + self.last[state]

    def encode(self, text: str) -> array:
        ids = array("i")
        ids.frombytes(b"".join(map(self.words.__getitem__, self.split(text))))
        return ids


class Decoder:
    """Token ids to text, as a stream: an incremental UTF-8 machine whose letters are tokens.

    The machine's state is the bytes of a character that is not whole yet. Tokens that are whole
    characters leave it at rest; the step for any other token is worked out once for each state.
    Bytes that can't be part of UTF-8 come out as U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.whole: list[str | None] = [None] * (max(self.bytes_of) + 1)
        for i, b in self.bytes_of.items():
            try:
                self.whole[i] = b.decode()
            except UnicodeDecodeError:
                self.whole[i] = None
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    @staticmethod
    def feed(state: bytes, data: bytes) -> tuple[bytes, str]:
        """The state after ``data`` and the characters that became certain."""
        out = []
        for byte in data:
            while True:
                if not state:
                    if byte < 0x80:
                        out.append(chr(byte))
                    elif 0xC2 <= byte <= 0xF4:
                        state = bytes([byte])
                    else:
                        out.append("�")
                    break
                lead, n = state[0], len(state)
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if n == 1 else 0x80
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if n == 1 else 0xBF
                if low <= byte <= high:
                    state += bytes([byte])
                    if len(state) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        out.append(state.decode())
                        state = b""
                    break
                out.append("�")
                state = b""
        return state, "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = b""
        for i in ids:
            if not state and (text := self.whole[i]) is not None:
                yield text
                continue
            found = self.steps.get((state, i))
            if found is None:
                found = self.steps[state, i] = self.feed(state, self.bytes_of[i])
            state, text = found
            yield text
        if state:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        parts = list(map(self.whole.__getitem__, ids))
        return "".join(self.stream(ids)) if None in parts else "".join(parts)


_LOADED: dict = {}


def _loaded(kind: type, vocabulary: str, *more):
    """One machine a worker process: building it costs a second."""
    key = (kind, vocabulary, *more)
    if key not in _LOADED:
        _LOADED.clear() if len(_LOADED) > 8 else None
        _LOADED[key] = kind(load_ranks(vocabulary), *more)
    return _LOADED[key]


def release() -> None:
    """Let go of the machines that this worker keeps, where a step that does not encode follows in it."""
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def _bounded(b: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches, so that a batch of long texts stays small too."""
    for i in range(0, b.num_rows, most):
        yield b.slice(i, most)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) more: its texts, whole, as BPE tokens.

    With ``decoded``, a column of that name holds what the decoder makes of the ids, as a stream. A null
    text is encoded as an empty one; special tokens are ordinary text. Rows are encoded one by one, so
    repeated rows and extra columns pass unchanged; columns of the names of the new ones are replaced.
    Very long texts are encoded whole, and give one long list. An empty table gives an empty result.
    """
    new = [c for c in (ids, decoded) if c]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables below hold no cycles, and scanning them doubles the time
        try:
            machine = _loaded(Transducer, vocabulary, pattern)
            back = _loaded(Decoder, vocabulary) if decoded else None
            for whole in batches:
                for b in _bounded(whole):
                    flat, ends, texts = array("i"), array("i", [0]), []
                    for value in b.column(at):
                        found = machine.encode(value.as_py() or "")
                        flat.extend(found)
                        ends.append(len(flat))
                        if back:
                            texts.append(back.decode(found))
                    lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                    more = [pa.array(texts, pa.string())] if back else []
                    yield pa.RecordBatch.from_arrays([*b.columns, lists, *more], [*kept, *new])
        finally:
            gc.enable()

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.StringType()) for c in new[1:]]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *fields]))


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of its token ids in the column ``text``; null ids give an empty text."""
    kept = [c for c in rows.columns if c.lower() != text.lower()]
    frame = rows.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _loaded(Decoder, vocabulary)
        for whole in batches:
            for b in _bounded(whole):
                texts = [machine.decode(v.values.to_numpy().tolist() if v.is_valid else ()) for v in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*kept, text])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(text, T.StringType())]))
