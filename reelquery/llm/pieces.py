"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

All distinct units of a batch of texts advance together, one character a step, in numpy. The ids
of those that came lately are kept, as most words of a batch were in batches before it.
A unit is what no piece can cross: a run of marks (U+2581, a space) with the characters up to
the next mark, or one character that no piece has.

At each position the output links of the automaton's state give all pieces that end there, and
the best way to reach the position is relaxed over them. For a unigram model the best is the
greatest sum of scores. A BPE model has ranks, not log-probabilities, and the greatest sum
isn't the segmentation it defines; there a step from piece a to piece b counts as 0 if merging
the characters of a and b by rank gives back a and b, and as minus infinity otherwise. Exactly
one way through the lattice then has a finite score, and it is the model's segmentation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from reelquery.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that are advanced together.
CHUNK = 750_000
#: Units whose ids are kept, twice so many at most, and the characters of the longest of them.
KEPT, LONGEST = 200_000, 64
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        shift = value = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, b[i : i + n]
            i += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(pieces as text, score, type; whether it is BPE) of a model file without normalisation of its own."""
    pieces, bpe = [], False
    for f, v in _fields(data):
        if f == 1:
            x = {1: b"", 2: struct.pack("<f", 0), 3: _NORMAL} | dict(_fields(v))
            pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0], x[3]))
        elif f == 2:
            bpe = dict(_fields(v)).get(3, 1) == 2
        elif f == 3:
            spec = dict(_fields(v))
            if spec.get(1, b"identity") != b"identity" or spec.get(3, 1) != 1 or spec.get(4, 1) != 0:
                raise ValueError("only models with identity normalisation, a dummy prefix and all white space kept")
    return pieces, bpe


class Hash:
    """Open addressing from non-negative int64 keys to int32 values, with vectorised lookup."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.count = len(keys)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo = np.arange(len(keys))
        at = self._at(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for keys that aren't here."""
        at = self._at(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], -1)
        todo = np.flatnonzero((got != keys) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Units:
    """The ids of units, by the units' hashes. The characters are kept too, and compared."""

    def __init__(self, code: np.dtype | type):
        self.keys = np.empty(0, np.uint64)  # ascending
        self.code_at, self.size, self.ids_at, self.count = (np.empty(0, np.int64) for _ in range(4))
        self.code, self.ids = np.empty(0, code), np.empty(0, np.int32)

    def find(self, keys: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those of the units that are here, their rows)."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        who = np.flatnonzero((self.keys[at] == keys) & (self.size[at] == size))
        at, n = at[who], size[who]
        if not len(who):
            return who, at
        same = np.logical_and.reduceat(self.code[_ranges(self.code_at[at], n)] == code[_ranges(start[who], n)], np.cumsum(n) - n)
        return who[same], at[same]

    def add(self, keys: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, ids_at: np.ndarray, count: np.ndarray) -> None:
        """keys: ascending. Of units with one hash the first stays."""
        if len(self.keys):
            new = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys)
            keys, start, size, ids_at, count = keys[new], start[new], size[new], ids_at[new], count[new]
        at = np.searchsorted(self.keys, keys)
        for name, x in (("code_at", len(self.code) + np.cumsum(size) - size), ("size", size), ("ids_at", len(self.ids) + np.cumsum(count) - count), ("count", count), ("keys", keys)):
            setattr(self, name, np.insert(getattr(self, name), at, x))
        self.code = np.append(self.code, code[_ranges(start, size)].astype(self.code.dtype))
        self.ids = np.append(self.ids, ids[_ranges(ids_at, count)])


class Codec:
    """Encoder and decoder of one model. It pickles; what it learns of pairs of pieces and of units stays in the process."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool):
        self.bpe, self.size = bpe, len(pieces)
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == _NORMAL]
        if any(kind not in (1, 2, 3, 6) for _, _, kind in pieces) or any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("only models without user-defined or unused pieces, with marks only at the start of pieces")
        self.ids = {p: i for i, p, _ in normal}
        self.texts = [p for p, _, _ in pieces]
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN)
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.bytes = [byte_ids.get(b, self.unknown) for b in range(256)]
        chars = {c for p in self.ids for c in p}
        if bpe and any(c not in self.ids for c in chars):
            raise ValueError("only BPE models with a piece for each character")
        self.code = np.zeros(0x110000, np.int32)  # 0: no piece has the character
        self.code[[ord(c) for c in sorted(chars)]] = np.arange(1, len(chars) + 1)
        self.code[ord(" ")] = self.code[ord(MARK)]
        self.mark, self.width = int(self.code[ord(MARK)]), len(chars) + 1
        self._automaton()
        raw = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind == _NORMAL else b"" if kind != _UNKNOWN else " ⁇ ".encode() for p, _, kind in pieces]
        self.raw, self.raw_len = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def _automaton(self) -> None:
        """goto (state and character), fail, and out: the longest piece at the end of a state, then link by link shorter ones."""
        children: list[dict[int, int]] = [{}]
        piece, depth = [-1], [0]
        for p, i in self.ids.items():
            s = 0
            for c in self.code[[ord(c) for c in p]].tolist():
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    piece.append(-1)
                    depth.append(depth[s] + 1)
                s = children[s][c]
            piece[s] = i
        fail, out, link = [0] * len(children), [-1] * len(children), [-1] * len(children)
        queue = [0]
        for s in queue:
            for c, n in children[s].items():
                f = fail[s]
                while s and f and c not in children[f]:
                    f = fail[f]
                fail[n] = children[f].get(c, 0) if s else 0
                link[n] = out[fail[n]]
                out[n] = n if piece[n] >= 0 else link[n]
                queue.append(n)
        edges = [(s * self.width + c, n) for s, x in enumerate(children) for c, n in x.items()]
        self.goto = Hash(np.array([k for k, _ in edges], np.int64), np.array([n for _, n in edges], np.int32))
        self.fail, self.out, self.link = (np.array(x, np.int32) for x in (fail, out, link))
        self.piece, self.depth = np.array(piece, np.int32), np.array(depth, np.int32)
        self.root = np.zeros(self.width, np.int32)
        for c, n in children[0].items():
            self.root[c] = n

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_pairs", "_merges", "_seen")}

    def merged(self, text: str) -> list[int]:
        """BPE as it is defined: the adjacent pair with the best score is merged, the leftmost of equals, until none is a piece."""
        merges = self.__dict__.setdefault("_merges", {})
        at = [self.ids[c] for c in text]
        while len(at) > 1:
            best, where, to = -np.inf, -1, -1
            for i in range(len(at) - 1):
                key = at[i] * self.size + at[i + 1]
                m = merges.get(key)
                if m is None:
                    j = self.ids.get(self.texts[at[i]] + self.texts[at[i + 1]], -1)
                    m = merges[key] = (float(self.scores[j]), j) if j >= 0 else (-np.inf, -1)
                if m[0] > best:
                    best, where, to = m[0], i, m[1]
            if where < 0:
                break
            at[where : where + 2] = [to]
        return at

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the two pieces' text gives the two pieces."""
        keys = a.astype(np.int64) * self.size + b
        tables = self.__dict__.setdefault("_pairs", [])
        got = np.full(len(keys), -1, np.int32)
        for t in tables:
            miss = np.flatnonzero(got < 0)
            got[miss] = t.get(keys[miss])
        if (got < 0).any():
            new, where = np.unique(keys[got < 0], return_inverse=True)
            x, y = new // self.size, new % self.size
            fresh = np.fromiter((self.merged(self.texts[i] + self.texts[j]) == [i, j] for i, j in zip(x.tolist(), y.tolist())), np.int32, len(new))
            got[got < 0] = fresh[where]
            if sum(t.count for t in tables) > 4_000_000:  # forgetting costs time, never a result
                tables.clear()
            # Each table has at least four times as many pairs as the next, so that they are few and a pair is moved a few times only.
            while tables and tables[-1].count < 4 * len(new):
                old = tables.pop()
                held = old.keys >= 0
                new, fresh = np.append(new, old.keys[held]), np.append(fresh, old.values[held])
            tables.append(Hash(new, fresh))
        return got == 1

    def _units(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the units, given in descending order of size, all of them of known characters."""
        n, longest = len(start), int(size[0])
        last = np.full((n, longest + 1), -1, np.int32)  # the state whose piece ends at a position
        best = None if self.bpe else np.full((n, longest + 1), -np.inf)
        if best is not None:
            best[:, 0] = 0
        state = np.zeros(n, np.int32)
        ends = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # units longer than t
        for t in range(longest):
            m = int(ends[t])
            c = code[start[:m] + t]
            s = state[:m]
            new = np.where(s == 0, self.root[c], -1)
            todo = np.flatnonzero(s != 0)
            at = s[todo]
            while len(todo):
                to = self.goto.get(at.astype(np.int64) * self.width + c[todo])
                to = np.where((to < 0) & (at == 0), 0, to)
                new[todo] = to
                keep = to < 0
                todo, at = todo[keep], self.fail[at[keep]]
            state[:m] = s = new
            todo = np.arange(m)
            out = self.out[s]
            while len(todo):
                keep = out >= 0
                todo, out = todo[keep], out[keep]
                if not len(todo):
                    break
                before = t + 1 - self.depth[out]
                if self.bpe:
                    ok = before == 0
                    prev = last[todo, before]
                    rest = np.flatnonzero(~ok & (prev >= 0))
                    ok[rest] = self.compatible(self.piece[prev[rest]], self.piece[out[rest]])
                    last[todo[ok], t + 1] = out[ok]
                    todo, out = todo[~ok], self.link[out[~ok]]
                else:
                    score = best[todo, before] + self.scores[self.piece[out]]
                    ok = score > best[todo, t + 1]
                    best[todo[ok], t + 1] = score[ok]
                    last[todo[ok], t + 1] = out[ok]
                    out = self.link[out]
        count = np.zeros(n, np.int64)
        pos, live = size.copy(), np.arange(n)
        steps = []
        while len(live):
            got = last[live, pos[live]]
            steps.append((live, self.piece[got]))
            count[live] += 1
            pos[live] -= self.depth[got]
            live = live[pos[live] > 0]
        ids = np.empty(int(count.sum()), np.int32)
        at = np.cumsum(count) - 1
        for who, p in steps:
            ids[at[who]] = p
            at[who] -= 1
        return ids, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not any(texts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        first = np.empty(len(code), bool)
        first[0] = True
        first[1:] = ((code[1:] == self.mark) & (code[:-1] != self.mark)) | (code[1:] == 0) | (code[:-1] == 0)
        text_at = np.cumsum(chars) - chars
        first[text_at[chars > 0]] = True
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(code))
        strange = code[start] == 0
        # A unit's 64-bit polynomial hash; equal ones are compared below.
        power = np.cumprod(np.full(len(code), _MIX))
        back = np.cumprod(np.full(len(code), np.uint64(pow(int(_MIX), -1, 1 << 64))))
        total = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power)
        key = (total[start + size - 1] - np.where(start > 0, total[start - 1], np.uint64(0))) * back[start]
        key, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        same = one[inverse]
        shift = np.repeat(start[same] - start, size)
        clash = not (size[same] == size).all() or not (code[np.arange(len(code)) + shift] == code).all()
        if clash:
            one, inverse = np.arange(len(start)), np.arange(len(start))
        count = np.zeros(len(one), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # units and their ids
        slot = np.flatnonzero(~strange[one])
        young, old = self.__dict__.setdefault("_seen", [Units(np.uint16 if self.width < 1 << 16 else np.int32) for _ in range(2)])
        fresh = np.empty(0, np.int64)
        if not clash:
            fresh = slot[size[one[slot]] <= LONGEST]
            for known in (young, old):
                rest = slot if known is young else slot[count[slot] == 0]
                who, at = known.find(key[rest], code, start[one[rest]], size[one[rest]])
                n = count[rest[who]] = known.count[at]
                parts.append((rest[who], known.ids[_ranges(known.ids_at[at], n)]))
                if known is young:
                    fresh = fresh[count[fresh] == 0]
            slot = slot[count[slot] == 0]
        rank = one[slot]
        order = np.argsort(-size[rank], kind="stable")
        rank, slot = rank[order], slot[order]
        at = 0
        while at < len(rank):  # tables of at most 8 million cells; in large ones all units are longer than half of the longest
            width = int(size[rank[at]]) + 1
            to = len(rank)
            if (to - at) * width > 1_000_000:
                to = at + int(np.searchsorted(-size[rank[at:]], -max(1, width // 2), side="right"))
            to = max(at + 1, min(to, at + 8_000_000 // width))
            ids, n = self._units(code, start[rank[at:to]], size[rank[at:to]])
            count[slot[at:to]] = n
            parts.append((slot[at:to], ids))
            at = to
        for j in np.flatnonzero(strange[one]).tolist():
            ids = [self.bytes[b] for b in chr(points[start[one[j]]]).encode("utf-8", "replace")]
            if self.unknown in ids:
                ids = [self.unknown]
            count[j] = len(ids)
            parts.append((np.array([j]), np.array(ids, np.int32)))
        pool = np.concatenate([ids for _, ids in parts])
        pool_at = np.empty(len(one), np.int64)
        made = 0
        for who, ids in parts:
            pool_at[who] = made + np.cumsum(count[who]) - count[who]
            made += len(ids)
        young.add(key[fresh], code, start[one[fresh]], size[one[fresh]], pool, pool_at[fresh], count[fresh])
        if len(young.keys) > KEPT:
            self._seen = [Units(young.code.dtype), young]
        n = count[inverse]
        out = pool[np.repeat(pool_at[inverse] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        per_text = np.add.reduceat(np.append(n, 0), np.searchsorted(start, text_at)) if len(n) else np.zeros(len(texts), np.int64)
        return out, np.where(chars > 0, per_text, 0)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts; what isn't valid UTF-8 becomes U+FFFD."""
        n = self.raw_len[ids]
        flat = self.raw[np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(count))].tolist()
        out = [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t[:1] == " " else t for t in out]


def codec(path: str = MODEL) -> Codec:
    with open(path, "rb") as f:
        return Codec(*read_model(f.read()))


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, end, texts) of ranges of rows with about most characters together; a longer text is alone. Only these texts are held."""
    a = n = 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        n += size
        if n > most and i > a:
            yield a, i, column.slice(a, i - a).to_pylist()
            a, n = i, size
    if a < len(column):
        yield a, len(column), column.slice(a).to_pylist()


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, decoded for every row: the whole text's pieces, and the text decoded from them.

    decoded equals text, but that U+2581 becomes a space. Null texts have null ids and decoded,
    and no tokens; an empty text has no pieces. Repeated rows are encoded as often as they
    occur. The model file is read on the driver and travels to the executors.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, texts in chunks(batch.column(1)):
                part = [t or "" for t in texts]
                ids, n = model.encode(part)
                null = np.array([t is None for t in texts])
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                back = model.decode(ids, n)
                decoded = pa.array([None if x else t for t, x in zip(back, null)], pa.string()) if null.any() else pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(n), decoded], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens bigint, decoded string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
