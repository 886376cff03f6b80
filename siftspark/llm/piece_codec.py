"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines over the tropical semiring (weights add along a path, the least path wins):

* the *normaliser* takes characters to characters: a trie of the model's rewrites (its precompiled charsmap), left to right, the
  longest match first, and an arc that copies where none matches. The meta symbol for a space, the dummy prefix and the squeezing
  of spaces follow, as the model has them;
* the *lexicon* takes characters to pieces: a trie with an arc back to its start for each piece, weighing minus its score, and a path of
  heavy weight for a character that no piece spells, which gives its byte pieces or the unknown one;
* the *grammar* reads pieces. For a unigram model it has one state. For a BPE model a piece weighs nothing in the lexicon, and the
  grammar has a state for each last piece, with an arc of weight 0 from piece a to piece b where merging keeps a and b apart (see
  ``Grammar.holds``) and of infinite weight elsewhere; any sequence of finite weight is the one that merging arrives at,
  so the least path is the BPE segmentation, not an approximation of it.

A normalised input is composed with lexicon and grammar lazily: states are (position, grammar state) at the lexicon's start, which are
relaxed from left to right (unigram) or settled by weight (BPE), and the least path is read back. The composition has a bridge (a position that every path passes in the
start state) wherever no piece spells the two characters next to each other, and before a word's first meta symbol where no piece
holds one inside. Between bridges stretches are solved each for itself, and a worker remembers those it has solved, up to a bound. So
memory follows the longest stretch, not the text.

Defined results: null gives null ids, an empty text none. Unknown characters give byte pieces where the model has them, else the
unknown id, once for a run of them. Control pieces in a text are ordinary characters. ``decode`` takes back byte runs as UTF-8,
invalid bytes as U+FFFD. Where several paths weigh the same, the one found first stands (shorter pieces first). Repeated rows are
encoded alike, and an empty table gives an empty one. Only ids and text are read or written; other columns pass through, and those
named like a result, in any case of letters, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
_FALLBACK, _INFINITE = 1e6, float("inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5
_BPE = 2


class Normaliser:
    """The rewrites of a charsmap: a trie over characters whose states may have an output."""

    def __init__(self, rewrites: dict[str, str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.output: list[str | None] = [None]
        for key, value in rewrites.items():
            state = 0
            for c in key:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.output.append(None)
                state = self.arcs[state][c]
            self.output[state] = value
        first = {c for key in rewrites for c in key[:1]}
        # of ASCII texts, only rewrites that are ASCII all through can match
        self._plain = re.compile("|".join(map(re.escape, sorted((k for k in rewrites if k.isascii()), key=len, reverse=True))) or "(?!)")
        self._starts = first

    def __call__(self, text: str) -> str:
        if len(self.arcs) == 1:
            return text
        if text.isascii():
            return self._plain.sub(lambda m: self._longest(text, m.start())[1], text)
        out, at, n, starts = [], 0, len(text), self._starts
        while at < n:
            if text[at] in starts:
                at, piece = self._longest(text, at)
                out.append(piece)
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def _longest(self, text: str, at: int) -> tuple[int, str]:
        """(end, output) of the longest rewrite that begins at a place, or of a copy of its character."""
        state, end, found = 0, at + 1, text[at]
        for i in range(at, len(text)):
            state = self.arcs[state].get(text[i], -1)
            if state < 0:
                break
            if self.output[state] is not None:
                end, found = i + 1, self.output[state]
        return end, found


def rewrites_of(charsmap: bytes) -> dict[str, str]:
    """The pairs of a precompiled charsmap: the size of a double-array trie, its units, and the outputs, each ended by a zero byte.

    A unit holds a label in its low byte, a flag for an output at bit 8, and an offset above; a unit with bit 31 holds a value."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64)
    outputs = charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    found: dict[str, str] = {}
    labels = np.arange(1, 256)
    todo = [(int(offset(units[0])), b"")]
    while todo:
        base, key = todo.pop()
        to = base ^ labels
        to, own = to[to < len(units)], labels[to < len(units)]
        fits = (units[to] & ((1 << 31) | 0xFF)) == own
        for node, label in zip(to[fits].tolist(), own[fits].tolist(), strict=True):
            unit, more = int(units[node]), key + bytes([label])
            below = node ^ int(offset(unit))
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[more.decode()] = outputs[start : outputs.index(b"\0", start)].decode()
            todo.append((below, more))
    return found


@dataclass
class Machines:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    bpe: bool
    dummy_prefix: bool
    squeeze: bool
    rewrites: dict[str, str] = field(default_factory=dict)
    number: dict[str, int] = field(default_factory=dict)
    bytes_: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    #: weight of each piece in the lexicon, and of a character that no piece spells
    weights: list[float] = field(default_factory=list)
    fallback: float = _FALLBACK
    longest: int = 1
    joined: frozenset[str] = frozenset()
    bridges: re.Pattern | None = None

    def __post_init__(self) -> None:
        spelled = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (_NORMAL, _USER)]
        self.number = dict(spelled)
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        if self.bpe:
            self.weights = [0.0] * len(self.pieces)
        else:  # user pieces win over any way to spell them, and unknown characters lose
            scores = [self.scores[i] for _, i in spelled if self.kinds[i] == _NORMAL] or [0.0]
            self.weights = [-(len(p) * max(scores) - 0.1) if k == _USER else -x for p, k, x in zip(self.pieces, self.kinds, self.scores, strict=True)]
            self.fallback = 10.0 - min(scores)
        self.longest = max((len(p) for p in self.number), default=1)
        self.joined = frozenset(p[i : i + 2] for p in self.number for i in range(len(p) - 1))
        self.bridges = self._bridges()

    def _bridges(self) -> re.Pattern | None:
        """A pattern of stretches between bridges, from the pairs of characters that stand together in some piece. It cuts
        before the meta symbol, around ASCII characters that are in no piece, and between a character and an ASCII mark (no
        letter or digit) where no piece has that mark after anything but a mark or the meta symbol. None where a piece
        holds the meta symbol inside."""
        if any(b == META and a != META for a, b in self.joined):
            return None
        spelled = {c for p in self.number for c in p}
        alone = {chr(c) for c in range(128)} - spelled
        marks = {chr(c) for c in range(128) if not chr(c).isalnum()}
        before = {c: {a for a, b in self.joined if b == c and a not in marks and a != META} for c in marks - alone}
        after = {c for c, x in before.items() if not any(a.isascii() for a in x)}
        glue = marks.union(*(before[c] for c in after))
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        inner = f"[^{META}{group(alone | after)}]" + (f"|(?<=[{group(glue)}])[{group(after)}]" if after else "")
        own = f"[{group(alone)}]|" if alone else ""
        return re.compile(f"{own}{META}*[^{META}{group(alone)}](?:{inner})*|{META}+")


def load(path: str = MODEL) -> Machines:
    """Compile the machines of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(Path(path).read_bytes())
    return Machines([p.piece for p in m.pieces], [p.type for p in m.pieces], [p.score for p in m.pieces], m.trainer_spec.model_type == _BPE, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, rewrites_of(m.normalizer_spec.precompiled_charsmap))


class Grammar:
    """Which piece may follow which. A piece is a tree of merges; merges run by score, then from the left. Along the
    boundary of a and b lie the right spine of a and the left spine of b. Two nodes of the spines are neighbours while
    both exist; if their union is a piece that would merge before either joins its parent, a and b don't stay apart."""

    def __init__(self, m: Machines) -> None:
        self.m = m
        self._spine: dict[tuple[str, bool], list[tuple[str, tuple, tuple]]] = {}
        self.pairs: dict[int, float] = {}

    def _rank(self, piece: str) -> float:
        i = self.m.number.get(piece)
        return -self.m.scores[i] if i is not None else float("inf")

    def _merges(self, piece: str) -> list[tuple[int, int, int]] | None:
        """The merges that build the piece, as (start, middle, end) in order; None where merging doesn't arrive at it."""
        cuts, out = list(range(len(piece) + 1)), []
        while len(cuts) > 2:
            best = min((self._rank(piece[cuts[i] : cuts[i + 2]]), i) for i in range(len(cuts) - 2))
            if best[0] == float("inf"):
                return None
            i = best[1]
            out.append((cuts[i], cuts[i + 1], cuts[i + 2]))
            del cuts[i + 1]
        return out

    def spine(self, piece: str, right: bool) -> list[tuple[str, tuple, tuple]] | None:
        """Nodes at the piece's right (or left) edge, smallest first: (text, birth, death) in the order of merges."""
        key = (piece, right)
        if key not in self._spine:
            merges = self._merges(piece)
            if merges is None:
                self._spine[key] = None
            else:
                late, edge, at, born = float("-inf"), [], (len(piece) - 1, len(piece)) if right else (0, 1), float("-inf")
                for s, mid, e in merges:
                    late = max(late, self._rank(piece[s:e]))
                    if (right and e == len(piece)) or (not right and s == 0):
                        edge.append((piece[at[0] : at[1]], born, late))
                        at, born = (s, e), late
                edge.append((piece[at[0] : at[1]], born, float("inf")))
                self._spine[key] = edge
        return self._spine[key]

    def sound(self, piece: int) -> bool:
        return self.spine(self.m.pieces[piece], True) is not None

    def holds(self, a: int, b: int) -> bool:
        return self._apart(self.m.pieces[a], self.m.pieces[b])

    def weigh(self, state: int, piece: int) -> float:
        """Weight of the arc that reads a piece, remembered up to a bound. State and piece are -1 for the start and -2 for a
        character outside the lexicon, next to which any piece may stand that merging arrives at."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        if piece < 0:
            fits = True
        else:
            fits = self.sound(piece) if state < 0 else self.holds(state, piece)
        found = self.pairs[(state + 2) << 20 | (piece + 2)] = 0.0 if fits else _INFINITE
        return found

    def _apart(self, a: str, b: str) -> bool:
        if set(a) == {META} == set(b):  # ties in score all the way: only the order from the left decides
            return self._replay(a, b)
        left, right = self.spine(a, True), self.spine(b, False)
        if left is None or right is None:
            return False
        number, scores = self.m.number, self.m.scores
        for x, xb, xd in left:
            for y, yb, yd in right:
                i = number.get(x + y)
                if i is not None and max(xb, yb) < min(xd, yd):
                    when = max(-scores[i], xb, yb)
                    if when < xd and when <= yd:
                        return False
        return True

    def _replay(self, a: str, b: str) -> bool:
        text = a + b
        cuts = list(range(len(text) + 1))
        while True:
            best = min(((self._rank(text[cuts[i] : cuts[i + 2]]), i) for i in range(len(cuts) - 2)), default=(float("inf"), 0))
            if best[0] == float("inf"):
                return cuts == [0, len(a), len(text)]
            del cuts[best[1] + 1]


class Codec:
    """Encodes and decodes; one for each worker."""

    def __init__(self, machines: Machines, most_stretches: int = 250_000) -> None:
        self.m, self.grammar, self.most = machines, Grammar(machines), most_stretches
        #: stretches solved since the last turn, and those of the turn before, which are forgotten at the next one
        self.solved: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: nodes are [arcs, piece or None]
        self.trie: list = [{}, None]
        for piece, i in machines.number.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = i
        self._cut = machines.bridges
        self.normalise = Normaliser(machines.rewrites)

    # -- composition and shortest path ---------------------------------------------------------------------------------
    def shortest(self, s: str) -> list[int]:
        """Ids on the least path of the composition of one stretch with lexicon and grammar. A composed state is a position and a grammar
        state: the last piece of a BPE model, and always the same one of a unigram model."""
        return self._ids(s, self._settled(s) if self.m.bpe else self._relaxed(s))

    def _relaxed(self, s: str) -> list[tuple[int, int, int]]:
        """With one grammar state: positions are closed from left to right, as every arc leads on."""
        n, weights, fallback = len(s), self.m.weights, self.m.fallback
        weight, last, before = [0.0] + [_INFINITE] * n, [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            for end, piece in self._arcs(s, at):
                w = weight[at] + (weights[piece] if piece >= 0 else fallback)
                if w < weight[end]:
                    weight[end], last[end], before[end] = w, piece, at
        path, at = [], n
        while at > 0:
            path.append((before[at], at, last[at]))
            at = before[at]
        return path[::-1]

    def _settled(self, s: str) -> list[tuple[int, int, int]]:
        """With a grammar state for each last piece: states are settled by weight (none is below 0), of equal ones the farthest first, so
        that most of the composition is never built. The grammar, whose arcs weigh nothing or are infinite, is asked about an arc when it is taken, not when it
        is found, as most are never taken. A state is ``position << 21 | piece + 2``."""
        n, known, weigh, fallback, places = len(s), self.grammar.pairs.get, self.grammar.weigh, self.m.fallback, (1 << 21) - 1
        heap, back, at, key, weight = [], {}, 0, 1, 0.0
        while at < n:
            for end, piece in self._arcs(s, at):
                heappush(heap, (weight if piece >= 0 else weight + fallback, -end, piece + 2, key))
            while heap:
                weight, minus, state, before = heappop(heap)
                key = -minus << 21 | state
                if key in back:
                    continue
                last = before & places
                more = known(last << 20 | state)
                if (weigh(last - 2, state - 2) if more is None else more) == 0:
                    break
            else:
                raise ValueError(f"no path through {s!r}")
            back[key] = before
            at = -minus
        path = []
        while key != 1:
            before = back[key]
            path.append((before >> 21, key >> 21, (key & places) - 2))
            key = before
        return path[::-1]

    def _arcs(self, s: str, at: int) -> list[tuple[int, int]]:
        """Lexicon arcs from a position, the shortest first: (end, piece), piece -2 for the byte fallback of one character."""
        arcs, found, end = self.trie[0], [], at
        for c in s[at : at + self.m.longest]:
            node = arcs.get(c)
            if node is None:
                break
            end += 1
            arcs, piece = node
            if piece is not None:
                found.append((end, piece))
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, -2))
        return found

    def _ids(self, s: str, path: list[tuple[int, int, int]]) -> list[int]:
        m, out = self.m, []
        for start, end, piece in path:
            if piece >= 0:
                out.append(piece)
            elif m.bytes_:
                out += [m.bytes_[b] for b in s[start:end].encode("utf-8", "surrogatepass")]
            else:
                out.append(m.unknown)
        return out

    def _stretch(self, s: str) -> bytes:
        """Ids of a stretch, as int32 bytes, cut further at characters that no piece holds together."""
        joined, ids, at = self.m.joined, [], 0
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in joined:
                ids += self.shortest(s[at:i])
                at = i
        return np.array(ids + self.shortest(s[at:]), dtype=np.int32).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        text = self.normalise(text)
        if self.m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return b""
        s = (" " if self.m.dummy_prefix else "") + text
        s = s.replace(" ", META)
        solved, out = self.solved, []
        for part in self._cut.findall(s) if self._cut else [s]:
            ids = solved.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    ids = self._stretch(part)
                if len(part) <= 64:
                    if len(solved) >= self.most:
                        self.older, self.solved = solved, {}
                        solved = self.solved
                    solved[part] = ids
            out.append(ids)
        raw = b"".join(out)
        if self.m.bytes_:
            return raw
        ids = np.frombuffer(raw, np.int32)  # a run of unknown characters is one
        again = np.concatenate([[False], (ids[1:] == self.m.unknown) & (ids[:-1] == self.m.unknown)]) if len(ids) else np.empty(0, bool)
        return ids[~again].tobytes() if again.any() else raw

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    # -- the inverse transducer ----------------------------------------------------------------------------------------
    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        m, out, run = self.m, [], bytearray()
        for i in ids:
            kind = m.kinds[i]
            if kind == _BYTE:
                run.append(int(m.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if kind == _UNKNOWN:
                out.append(" ⁇ ")
            elif kind != _CONTROL:
                out.append(m.pieces[i])
        if run:
            out.append(_utf8(bytes(run)))
        s = "".join(out).replace(META, " ")
        return s[1:] if m.dummy_prefix and s[:1] == " " else s

    def decode_array(self, ids: np.ndarray) -> str:
        """``decode`` for ids that are mostly ordinary pieces: one lookup an id."""
        if not len(ids):
            return ""
        special = self._special[ids]
        if special.any():
            return self.decode(ids.tolist())
        s = "".join(map(self._shown.__getitem__, ids.tolist()))
        return s[1:] if self.m.dummy_prefix and s[:1] == " " else s

    @property
    def _special(self) -> np.ndarray:
        if not hasattr(self, "_kinds"):
            self._kinds = np.array([k not in (_NORMAL, _USER) for k in self.m.kinds])
            self._texts = [p.replace(META, " ") for p in self.m.pieces]
        return self._kinds

    @property
    def _shown(self) -> list[str]:
        return self._texts


def _utf8(raw: bytes) -> str:
    """Each invalid byte gives one replacement character."""
    out = []
    while raw:
        try:
            out.append(raw.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode("utf-8") + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_codecs: dict[int, Codec] = {}


def _codec(machines: Machines) -> Codec:
    """The codec of a worker process, kept from task to task."""
    key = hash((tuple(machines.pieces), tuple(machines.scores), tuple(machines.kinds), machines.bpe, machines.dummy_prefix, machines.squeeze, len(machines.rewrites)))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(machines)
    return _codecs[key]


def encode(docs: DataFrame, text: str = "text", column: str = "ids", model: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with the ids of each text; with ``check``, also ``n_tokens`` and ``round_trip`` (decoding gives the text back,
    the meta symbol counting as a space). Works in the scan's own partitions; the driver reads the model, and workers get its machines with the
    task."""
    machines = load(model)
    new = {column.lower(), *(("n_tokens", "round_trip") if check else ())}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    passed = [f.name for f in kept]
    fields = [T.StructField(column, T.ArrayType(T.IntegerType()))] + ([T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())] if check else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(machines)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                raw = [None if t is None else c.encode_bytes(t) for t in texts]
                n = np.array([0 if x is None else len(x) // 4 for x in raw], dtype=np.int64)
                values = np.frombuffer(b"".join(x for x in raw if x), np.int32)
                ends = np.cumsum(n)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), pa.int32())
                blank = pa.array([x is None for x in raw], pa.bool_())
                cols = [batch.column(batch.schema.get_field_index(p)) for p in passed] + [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=blank)]
                if check:
                    back = [None if t is None else c.decode_array(values[e - k : e]) == t.replace(META, " ") for t, e, k in zip(texts, ends.tolist(), n.tolist(), strict=True)]
                    cols += [pa.array(n, pa.int64(), mask=np.array([x is None for x in raw])), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*passed, *(f.name for f in fields)])

    return docs.select(*passed, *([text] if text not in passed else [])).mapInArrow(run, T.StructType([*kept, *fields]))


def decode(rows: DataFrame, ids: str = "ids", column: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of each id list. Ids out of range are an error."""
    machines = load(model)
    kept = [f for f in rows.schema.fields if f.name.lower() != column.lower()]
    passed = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(machines)
        for batch in batches:
            out = [c.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(p)) for p in passed), pa.array(out, pa.string())], names=[*passed, column])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.StringType())]))
