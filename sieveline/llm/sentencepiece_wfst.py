"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers: the normaliser (text to normalised text: the model's character map, of
which the longest matching key is rewritten, then merged spaces, a dummy prefix, escaped spaces), the pieces (normalised
text to ids) and the byte fallback (one arc of byte ids for a character without a piece; without byte pieces, a run of
such characters is one unknown id). The normaliser has one path for each input, so composing it first gives one string;
composing that with pieces and fallback gives a lattice over its positions, and the encoding is the lattice's shortest
path in the tropical semiring (weights add along a path, the least total wins).

A unigram model's arc weighs minus its piece's score. A BPE model's weights stand between arcs: a state remembers the
piece that led to it, and a following piece weighs 0 if merging the two pieces' text from scratch by the model's scores
gives exactly these two pieces, else infinity. A sequence of pieces is what BPE makes of a text exactly if each
adjacent pair is, so one path has a finite weight, and each position keeps one state. User-defined pieces are taken from
the left, the longest first, before a BPE lattice is built; in a unigram lattice they are arcs of little weight.

Inputs are cut where no piece can cross (before a space that no piece holds inside, around characters that are in no
longer piece), so that chunks recur and their paths are looked up.

Defined results: a null text has null ids and count, an empty text the empty list; repeated rows are encoded alike; an
empty table gives an empty result; further columns pass through untouched. Decoding gives the normalised text with
spaces restored, so U+2581 in a text comes back as a space. Texts are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.text import free_name, keep_columns, ship_package, small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
UNIGRAM, BPE = 1, 2
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6

#: Chunks and pairs of pieces that a worker remembers at most, in each of two halves of which the older goes when the
#: newer is full, and the length up to which a chunk is remembered: some 60 MB a half at most.
CACHE_CHUNKS = 200_000
CACHE_LINKS = 50_000
CACHE_LENGTH = 32
CACHE_PAIRS = 200_000
#: Steps to shorter ends that the pieces' automaton remembers, some 20 MB.
CACHE_STEPS = 200_000


class Halves(dict):
    """A dictionary that fills itself and drops its older half when full."""

    def __init__(self, fill, limit: int):
        super().__init__()
        self.fill, self.limit, self.older = fill, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
            if isinstance(key, str) and len(key) > CACHE_LENGTH:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class State(dict):
    """A state of the pieces' automaton: the states that characters lead to, the arcs (length and id, longest first) that
    end here, and the state of the longest shorter end of what was read (None at the beginning)."""

    __slots__ = ("arcs", "back", "room")

    def __init__(self, arcs: tuple[tuple[int, int], ...], room: list[int]):
        self.arcs, self.back, self.room = arcs, None, room

    def __missing__(self, character: str) -> State:
        state = self if self.back is None else self.back[character]
        if self.room[0]:
            self.room[0] -= 1
            self[character] = state
        return state


@dataclass
class Transducer:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    dummy_prefix: bool = True
    merge_spaces: bool = False
    escape_spaces: bool = True
    space_suffix: bool = False
    charsmap: bytes = b""
    ids: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.longest = max(map(len, self.ids), default=1)
        normal = [self.scores[i] for i, k in enumerate(self.kinds) if k == NORMAL]
        self.worst = min(normal, default=0.0) - 10.0
        user = sorted((p for p, i in self.ids.items() if self.kinds[i] == USER_DEFINED), key=len, reverse=True)
        self._user = re.compile(f"({'|'.join(map(re.escape, user))})") if user else None
        self._user_ids = {p: np.array([self.ids[p]], np.int32).tobytes() for p in user}
        if self.algorithm == BPE:  # they never merge
            for p in user:
                self.ids.pop(p)
        # Fixed rule of the model format: a user-defined arc weighs its bytes times the best score (0 at least), less 0.1.
        best = max([0.0, *normal])
        self._weights = [0.1 - len(p.encode()) * best if k == USER_DEFINED else -s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        self._map = read_charsmap(self.charsmap)
        self._map_length = {}
        for key in self._map:
            self._map_length[key[0]] = max(len(key), self._map_length.get(key[0], 0))
        merged = Counter(self.scores[i] for p, i in self.ids.items() if len(p) > 1)
        self._tied = {s for s, n in merged.items() if n > 1}
        self._spines: dict[int, tuple[list[str], list[str]] | None] = {}
        self._joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._arcs = self._compile_arcs() if self.algorithm == BPE else None
        self._chunks = Halves(self._encode_chunk, CACHE_CHUNKS)
        self._links = Halves(self._encode_link, CACHE_LINKS)
        self._pairs = Halves(self._follows, CACHE_PAIRS)
        self._cut = self._compile_cut()
        self._bytes = [self._surface(i) for i in range(len(self.pieces))]
        self._starts = np.array([bool(b) for b in self._bytes])
        # What each id stands for, and again for an id at a text's start.
        self._surfaces = pa.array(self._bytes + [b[b[:1] == b" " :] if self.dummy_prefix else b for b in self._bytes], pa.large_binary())

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Transducer:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, model: bytes) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        columns = [[p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]]
        return cls(*columns, proto.trainer_spec.model_type, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix, spec.precompiled_charsmap)

    def __reduce__(self):
        return Transducer, (self.pieces, self.scores, self.kinds, self.algorithm, self.dummy_prefix, self.merge_spaces, self.escape_spaces, self.space_suffix, self.charsmap)

    # -- the parts

    def _rewrite(self, text: str) -> str:
        """The character map: at each place the longest key is replaced, other characters stay."""
        out, at, lengths = [], 0, self._map_length
        while at < len(text):
            for n in range(lengths.get(text[at], 0), 0, -1):
                found = self._map.get(text[at : at + n])
                if found is not None:
                    out.append(found)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def normalise(self, text: str) -> str:
        if self._map:
            parts = self._user.split(text) if self._user else [text]
            text = "".join(p if k % 2 else self._rewrite(p) for k, p in enumerate(parts))
        if self.merge_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = text + " " if self.space_suffix else " " + text
        return text.replace(" ", SPACE_MARK) if self.escape_spaces else text

    def _compile_arcs(self) -> State:
        """The pieces as an automaton that reads a text once: each state has the arcs that end where it is reached."""
        room = [CACHE_STEPS]
        begin, level = State((), room), []
        for p, i in self.ids.items():
            state = begin
            for c in p:
                child = dict.get(state, c)
                if child is None:
                    child = state[c] = State((), room)
                state = child
            state.arcs = ((len(p), i),)
        for child in begin.values():
            child.back = begin
            level.append(child)
        while level:
            below = []
            for state in level:
                state.arcs += state.back.arcs
                for c, child in list(state.items()):
                    back = state.back
                    while back is not begin and c not in back:
                        back = back.back
                    child.back = dict.get(back, c, begin)
                    below.append(child)
            level = below
        return begin

    def _compile_cut(self) -> re.Pattern[str] | None:
        """A pattern whose matches are the chunks of a normalised text, or None if spaces occur inside pieces."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in longer):
            return None
        joined = set("".join(longer))
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        rest = f"{SPACE_MARK}*[^{SPACE_MARK}{alone}]+|{SPACE_MARK}+"
        return re.compile(f"[{alone}]|{rest}" if alone else rest)

    def fallback(self, character: str) -> list[int]:
        raw = character.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown]

    # -- shortest paths

    def merge(self, text: str) -> list[str]:
        """BPE from scratch: the adjacent pair whose union scores best is merged, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                break
            k = min(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, pair: int) -> bool:
        """Whether the second piece may follow the first; the pair is (first + 1) * pieces + second, and first is -1
        at the start and after a fallback arc."""
        first, second = divmod(pair, len(self.pieces))
        before = self.pieces[first - 1] if first else ""
        after = self.pieces[second]
        if before and before[-1] + after[0] not in self._joints:
            return True  # nothing merges across
        if before:
            left, right = self._spine(first - 1), self._spine(second)
            if left and right and (known := self._stay_apart(left[1], right[0])) is not None:
                return known
        return self.merge(before + after) == ([before, after] if before else [after])

    def _spine(self, piece: int) -> tuple[list[str], list[str]] | None:
        """The pieces at the left and at the right end of a piece while it is merged from its characters, growing; None
        if it isn't made by merges of ever worse scores that no other piece has."""
        if piece not in self._spines:
            text = self.pieces[piece]
            parts, last, ends, steady = list(text), float("inf"), ([text[0]], [text[-1]]), True
            while len(parts) > 1 and steady:
                options = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
                if not options:
                    break
                cost, k = min(options)
                steady, last = -cost < last and -cost not in self._tied, -cost
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                for side, part in zip(ends, (parts[0], parts[-1]), strict=True):
                    if side[-1] != part:
                        side.append(part)
            self._spines[piece] = ends if steady and len(parts) == 1 else None
        return self._spines[piece]

    def _stay_apart(self, left: list[str], right: list[str]) -> bool | None:
        """Whether no two end pieces that stand side by side at some time merge before either is merged with its own
        side: the best score goes first, the left one of equals. None if scores of several pieces tie."""
        score = lambda text: self.scores[i] if (i := self.ids.get(text)) is not None else -float("inf")
        i = j = 0
        while True:
            next_left = score(left[i + 1]) if i + 1 < len(left) else -float("inf")
            next_right = score(right[j + 1]) if j + 1 < len(right) else -float("inf")
            across = score(left[i] + right[j])
            if across > next_left and across >= next_right and across > -float("inf"):
                return None if across in self._tied else False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if next_left >= next_right and i + 1 < len(left) or j + 1 == len(right):
                i += 1
            else:
                j += 1

    def _bpe_path(self, chunk: str) -> list[int]:
        state, pairs, width = self._arcs, self._pairs, len(self.pieces)
        last, start = [-1], [0]
        for end, c in enumerate(chunk, 1):
            state = state[c]
            for length, piece in state.arcs:
                begin = end - length
                if pairs[(last[begin] + 1) * width + piece]:
                    last.append(piece)
                    start.append(begin)
                    break
            else:
                last.append(-1)
                start.append(end - 1)
        return self._trace(chunk, last, start)

    def _unigram_path(self, chunk: str) -> list[int]:
        total, last, start = [0.0], [-1], [0]
        for end in range(1, len(chunk) + 1):
            best = (total[end - 1] - self.worst, -1, end - 1)
            for begin in range(max(0, end - self.longest), end):
                piece = self.ids.get(chunk[begin:end])
                if piece is not None and (weight := total[begin] + self._weights[piece]) < best[0]:
                    best = (weight, piece, begin)
            for values, value in zip((total, last, start), best, strict=True):
                values.append(value)
        return self._trace(chunk, last, start)

    def _trace(self, chunk: str, last: list[int], start: list[int]) -> list[int]:
        steps, end = [], len(chunk)
        while end:
            steps.append([last[end]] if last[end] >= 0 else self.fallback(chunk[start[end] : end]))
            end = start[end]
        return [i for step in reversed(steps) for i in step]

    def _encode_chunk(self, chunk: str) -> bytes:
        """Cut further between characters that are adjacent in no piece."""
        joints = self._joints
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in joints]
        if not cuts:
            return self._encode_link(chunk)
        return b"".join(self._links[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True))

    def _encode_link(self, chunk: str) -> bytes:
        path = self._bpe_path if self.algorithm == BPE else self._unigram_path
        return np.array(path(chunk), np.int32).tobytes()

    def forget(self) -> None:
        """Drop the older halves of what is remembered: workers are kept after a task and used for other work."""
        for memory in (self._chunks, self._links, self._pairs):
            memory.older = {}

    # -- encoding and decoding

    def encode_packed(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        normal = self.normalise(text)
        if self._user and self.algorithm == BPE:
            packed = b"".join(self._user_ids[part] if k % 2 else self._encode_part(part) for k, part in enumerate(self._user.split(normal)))
        else:
            packed = self._encode_part(normal)
        if len(self.byte_ids) == 256:
            return packed
        ids = np.frombuffer(packed, np.int32)
        unknown = ids == self.unknown
        return ids[~(unknown & np.concatenate(([False], unknown[:-1])))].tobytes()  # a run of unknowns is one

    def _encode_part(self, normal: str) -> bytes:
        if self._cut is None:
            return self._encode_chunk(normal)
        return b"".join(map(self._chunks.__getitem__, self._cut.findall(normal)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def _surface(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(SPACE_MARK, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join(map(self._bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def decode_rows(self, rows: pa.ListArray) -> pa.Array:
        """`decode` of each list of ids, side by side: what the ids of all rows stand for is one run of bytes, which the
        rows' ends cut. Rows of bytes that aren't UTF-8, or that start with an id of no bytes, are decoded one by one."""
        valid = rows.is_valid().to_numpy(zero_copy_only=False)
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ids = np.array(rows.flatten().to_numpy(zero_copy_only=False), np.int64)
        first = ends[:-1][sizes > 0]
        if self._starts[ids[first]].all():
            ids[first] += len(self._bytes)
            _, places, raw = self._surfaces.take(pa.array(ids)).buffers()
            cuts = np.frombuffer(places, np.int64, len(ids) + 1)[ends]
            texts = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts), raw if raw is not None else pa.py_buffer(b"")])
            try:
                return pc.if_else(pa.array(valid), texts.cast(pa.string()), pa.scalar(None, pa.string()))
            except pa.ArrowInvalid:
                pass
        return pa.array([self.decode(row.values.to_numpy()) if row.is_valid else None for row in rows], pa.string())


def read_charsmap(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a compiled character map: the size of a double-array trie over UTF-8 bytes, the trie, and
    the replacements, each ended by a zero byte. A unit of the trie holds a label, a flag for an end and an offset."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, replacements, labels = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :], np.arange(256)
    below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    found, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = int(units[at])
        base = at ^ below(unit)
        if unit & 256:  # has an end: the value stands under label 0
            start = int(units[base]) & 0x7FFFFFFF
            found[key] = replacements[start : replacements.index(b"\0", start)]
        places = base ^ labels
        inside = places < len(units)
        is_child = (units[np.where(inside, places, 0)] & 0x800000FF == labels) & inside
        todo += [(int(places[n]), key + bytes([n])) for n in np.flatnonzero(is_child).tolist() if n]
    return {k.decode(): v.decode() for k, v in found.items()}


def load_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def arrow_lists(packed: list[bytes | None]) -> pa.ListArray:
    """Lists of int32 from packed rows, without a Python object for each id."""
    sizes = [len(p) // 4 if p is not None else 0 for p in packed]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in packed if p is not None), np.int32))
    missing = pa.array([p is None for p in packed], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)


_LOADED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer, with what it remembers, for each worker process and model."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer.parse(model)
    return _LOADED[key]


def encode_texts(documents: DataFrame, model_path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """All columns of the documents, token_ids array<int> and n_tokens bigint, with underscores before these names where
    the documents have such columns. The model's file is read by the driver."""
    spark = documents.sparkSession
    ship_package(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_bytes(model_path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = compiled(shared.value)
        for batch in batches:
            yield arrow_lists([None if t is None else transducer.encode_packed(t) for t in batch.to_pylist()])
        transducer.forget()

    ids, count = free_name(documents, "token_ids"), free_name(documents, "n_tokens")
    return documents.withColumn(ids, encode(text)).withColumn(count, F.size(ids).cast("bigint"))


def decode_ids(frame: DataFrame, model_path: str = MODEL_PATH, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids decode to null."""
    spark = frame.sparkSession
    ship_package(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_bytes(model_path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = compiled(shared.value)
        for batch in batches:
            yield transducer.decode_rows(batch)

    return frame.withColumn(into, decode(ids))


def tokenized(documents: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip: whether decoding the ids gives back the text."""
    encoded = encode_texts(keep_columns(documents, "doc_id", "text"), model_path)
    decoded = decode_ids(encoded, model_path)
    return decoded.select("doc_id", F.when(F.col("token_ids").isNotNull(), F.col("n_tokens")).alias("n_tokens"), "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip"))
