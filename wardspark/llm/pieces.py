"""SentencePiece encoding and decoding with N-best segmentations of whole texts.

The lattice of a text has an edge for every vocabulary piece at every position, and the edges of its bytes for a
character that no piece covers; a segmentation's score is the sum of its pieces' scores. Because no piece has a blank
after another character, the lattice falls apart at words, exactly. Forward Viterbi runs over all distinct words of
a slice at once (numpy, rows are words, columns are bytes) and keeps the two best scores per position. Long texts
without blanks are walked by position over the edges found, so their time grows with their length and no more.

N-best: the forward scores are exact heuristics for a backward A* search, which therefore meets the segmentations of
a word in order of score. A text's N best segmentations deviate from the best one only in words whose second-best
score is closest: the N - 1 closest words hold all of them, so only those are searched, and a last best-first search
combines their lists.

The model is read on the driver from the path given (any SentencePiece file with byte fallback) and broadcast: its
size is that of the vocabulary. Texts are encoded whole; one task holds one slice of rows.

Defined cases: null and empty texts have no pieces, score 0 and one segmentation. A blank is led in front of every
other text, as the model was built; decoding drops it. A literal U+2581 is encoded as bytes and so survives. Ids
outside the vocabulary and control pieces decode to nothing; bytes that are not UTF-8 decode to U+FFFD. Of equal
scores the one met first by the search, shorter last pieces first, leads; equal texts have equal results.
"""

from __future__ import annotations

import heapq
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import SLICE_BYTES, map_batches, scanned

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
_LOW = -1e18
#: Units are padded to one of these lengths; a longer one is padded to a multiple of the last.
_WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: Of longer units fewer than this in a group are walked one by one, as steps over few rows cost as much as over many.
_FEW = 32
#: Starts in one block of a long unit.
_BLOCK = 1 << 16


@dataclass
class Vocabulary:
    """Pieces with blanks as 0x20; bytes are ids of single bytes; ``alone``: ASCII bytes in no longer piece."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    longest: int
    index: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        n = 1 << _TABLE_BITS
        usable = sorted(self.index.items())
        h = np.array([_hash(p) for p, _ in usable], np.uint64)
        self.keys, self.ids = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.probes = 1
        for key, (_, i) in zip(h.tolist(), usable, strict=True):
            slot, step = key >> (64 - _TABLE_BITS), 1
            while self.ids[slot] >= 0:
                slot, step = (slot + 1) % n, step + 1
            self.keys[slot], self.ids[slot] = key, i
            self.probes = max(self.probes, step)
        self.power = np.multiply.accumulate(np.full(self.longest + 1, _BASE, np.uint64))
        joined = {c for p in self.index if len(p) > 1 for c in p}
        self.alone = np.array([c < 0x80 and c not in joined for c in range(256)])
        sizes = [len(p) for p in self.pieces]
        self.text = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.size = np.array(sizes, np.int64)
        self.at = np.cumsum(self.size) - self.size

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, -1 for none."""
        n = 1 << _TABLE_BITS
        slot = (h >> _U(64 - _TABLE_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[slot] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + step) % n
            hit = (self.keys[s] == h[open_]) & (self.ids[s] >= 0)
            out[open_[hit]] = self.ids[s[hit]]
            open_ = open_[~hit & (self.ids[s] >= 0)]
        return out


def _hash(piece: bytes) -> int:
    """The same value as the difference of prefix hashes in ``viterbi``."""
    h = 0
    for c in piece:
        h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return int(bytesx.mix(np.array([h + len(piece)], np.uint64))[0])


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Vocabulary of a SentencePiece model file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, index, byte_ids = [], {}, np.full(256, -1, np.int64)
    scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())], np.float64)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            raw = p.replace(BLANK, " ").encode()
            if b" " in raw.lstrip(b" "):
                raise ValueError(f"piece {i} has a blank after another character")
            pieces.append(raw)
            index[raw] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    usable = scores[list(index.values())]
    return Vocabulary(pieces, scores, byte_ids, float(usable[usable > -1e8].min() - 10), max(map(len, index)), index)


def _char_sizes(u: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins at each byte; 0 inside a character."""
    return np.select([u < 0x80, u < 0xC0, u < 0xE0, u < 0xF0], [1, 0, 2, 3], 4)


def viterbi(v: Vocabulary, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, second, step) for padded units, a row each: the two best scores of each prefix, and its last edge.

    ``step`` is a piece's length, or minus a character's length if its bytes are used.
    """
    n, width = units.shape
    best, second = np.full((width + 1, n), _LOW), np.full((width + 1, n), _LOW)
    step = np.zeros((width + 1, n), np.int8)
    best[0] = 0
    prefix = np.zeros((width + 1, n), np.uint64)
    cols = np.ascontiguousarray(units.T)
    for i in range(width):
        prefix[i + 1] = prefix[i] * _BASE + cols[i] + _U(1)
    char = _char_sizes(cols)
    single = np.zeros((width, n), bool)  # characters that are pieces by themselves
    for e in range(1, width + 1):
        for k in range(1, min(e, v.longest) + 1):
            s = e - k
            power = v.power[k - 1]
            from_best = best[s]
            live = from_best > _LOW / 2
            if not live.any():
                continue
            h = bytesx.mix(prefix[e] - prefix[s] * power + _U(k))
            i = v.find(h)
            known = (i >= 0) & live
            if k <= 4:
                whole = char[s] == k
                single[s] |= known & whole
                raw = whole & ~single[s] & live
                score = np.where(known, v.scores[i], v.unknown)
                used = known | raw
            else:
                raw, score, used = None, v.scores[i], known
            at = np.flatnonzero(used)
            if not len(at):
                continue
            a = from_best[at] + score[at]
            b = second[s][at] + score[at]
            old = best[e][at]
            better = a > old
            second[e][at] = np.maximum(np.maximum(second[e][at], b), np.where(better, old, a))
            best[e][at] = np.where(better, a, old)
            length = np.where(raw[at], -k, k) if raw is not None else np.full(len(at), k)
            step[e][at] = np.where(better, length, step[e][at])
    return best, second, step


def spans(v: Vocabulary, unit: np.ndarray):
    """The edges of a long unit in blocks, by start and then length: (starts, lengths, piece ids), -1 for bytes.

    All starts of a block are looked up together, one step per length of a piece.
    """
    n = len(unit)
    power = np.ones(n + 1, np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = _U(pow(int(_BASE), -1, 1 << 64))
    inverse = np.multiply.accumulate(inverse)
    prefix = np.zeros(n + 1, np.uint64)
    prefix[1:] = np.cumsum((unit.astype(np.uint64) + _U(1)) * inverse[1:], dtype=np.uint64)
    prefix *= power
    char = _char_sizes(unit)
    for lo in range(0, n, _BLOCK):
        s = lo + np.flatnonzero(char[lo:lo + _BLOCK])
        starts, lengths, ids = [], [], []
        for k in range(1, min(v.longest, n - lo) + 1):
            s = s[s + k <= n]
            i = v.find(bytesx.mix(prefix[s + k] - prefix[s] * power[k] + _U(k)))
            used = (i >= 0) | (char[s] == k)
            starts.append(s[used])
            lengths.append(np.full(int(used.sum()), k))
            ids.append(i[used])
        starts, lengths, ids = (np.concatenate(x) for x in (starts, lengths, ids))
        order = np.lexsort((lengths, starts))
        yield starts[order], lengths[order], ids[order]


def walk(v: Vocabulary, unit: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(best score, second-best score, best ids) of one long unit, position by position over its edges.

    The results are those of ``viterbi``; time and memory grow with the unit's length.
    """
    n = len(unit)
    best, second = array("d", [_LOW]) * (n + 1), array("d", [_LOW]) * (n + 1)
    step, last = array("b", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    best[0] = 0.0
    for starts, lengths, ids in spans(v, unit):
        scores = np.where(ids >= 0, v.scores[ids], v.unknown)
        for s, k, i, score in zip(starts.tolist(), lengths.tolist(), ids.tolist(), scores.tolist(), strict=True):
            from_best = best[s]
            if from_best <= _LOW / 2:
                continue
            e, a, b = s + k, from_best + score, second[s] + score
            old = best[e]
            # edges come longest first here, so that of equal ones the shortest stays
            if a >= old:
                best[e], step[e], last[e] = a, k, i
                a = old
            second[e] = max(second[e], a, b)
    ids, e = [], n
    while e:
        s = e - step[e]
        if last[e] >= 0:
            ids.append(last[e])
        else:
            ids += v.byte_ids[unit[s:e][::-1]].tolist()
        e = s
    return best[n], second[n], np.array(ids[::-1], np.int64)


def edges(v: Vocabulary, unit: bytes) -> list[list[tuple[int, float, list[int]]]]:
    """Per end position the edges (start, score, ids) of a unit's lattice."""
    n = len(unit)
    out: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(n + 1)]
    if n > _WIDTHS[-1]:
        for found in spans(v, np.frombuffer(unit, np.uint8)):
            for s, k, i in zip(*(x.tolist() for x in found), strict=True):
                out[s + k].append((s, float(v.scores[i]), [i]) if i >= 0 else
                                  (s, v.unknown, [int(v.byte_ids[c]) for c in unit[s:s + k]]))
        return out
    for s in range(n):
        if unit[s] & 0xC0 == 0x80:
            continue
        size = 1 if unit[s] < 0x80 else 2 if unit[s] < 0xE0 else 3 if unit[s] < 0xF0 else 4
        for k in range(1, min(v.longest, n - s) + 1):
            i = v.index.get(unit[s:s + k])
            if i is not None:
                out[s + k].append((s, float(v.scores[i]), [i]))
            elif k == size:
                out[s + k].append((s, v.unknown, [int(v.byte_ids[c]) for c in unit[s:s + k]]))
    return out


def n_best(v: Vocabulary, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a unit: backward A* from its end with forward Viterbi scores as heuristics."""
    lattice = edges(v, unit)
    forward = [0.0] + [_LOW] * len(unit)
    for e in range(1, len(unit) + 1):
        forward[e] = max((forward[s] + score for s, score, _ in lattice[e]), default=_LOW)
    heap = [(-forward[-1], 0, len(unit), 0.0, None)]
    count, found = 1, []
    met = [0] * (len(unit) + 1)
    while heap and len(found) < n:
        _, _, at, behind, path = heapq.heappop(heap)
        met[at] += 1
        if met[at] > n:  # n paths at least as good go on from here in the same ways
            continue
        if at == 0:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((behind, ids))
            continue
        for s, score, ids in lattice[at]:
            if forward[s] > _LOW / 2:
                heapq.heappush(heap, (-(forward[s] + score + behind), count, s, behind + score, (ids, path)))
                count += 1
    return found


def combine(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best sums of one entry per list, entries in descending order: (sum, chosen entries)."""
    start = (0,) * len(lists)
    heap = [(-sum(x[0] for x in lists), start)]
    seen, out = {start}, []
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        out.append((-total, chosen))
        for j, x in enumerate(lists):
            if chosen[j] + 1 < len(x):
                nxt = (*chosen[:j], chosen[j] + 1, *chosen[j + 1:])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (-(-total - x[chosen[j]] + x[chosen[j] + 1]), nxt))
    return out


def _units(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units, and the row offsets into them: a unit begins at a blank after another byte, and around bytes
    that no longer piece holds."""
    begin = np.zeros(len(data) + 1, bool)
    blank = data == 0x20
    alone = v.alone[data]
    if len(data):
        begin[1:-1] = blank[1:] & ~blank[:-1] | alone[1:] | alone[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.searchsorted(starts, offsets)


def encode_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, n: int, cache: dict):
    """(ids, id offsets, scores, alternatives) of the rows of a slice; each row has its leading blank already."""
    rows = len(offsets) - 1
    starts, row_units = _units(v, data, offsets)
    ends = np.append(starts[1:], len(data))
    hashes = bytesx.span_hashes(data, starts, ends)
    _, first, unit_of = np.unique(hashes, return_index=True, return_inverse=True)
    lens = (ends - starts)[first]
    m = len(first)
    score, gap = np.zeros(m), np.zeros(m)
    piece_lists: list = []
    order_of = np.zeros(m, np.int64)
    count = np.zeros(m, np.int64)
    flat_base = 0
    width_of = np.where(lens <= _WIDTHS[-1], np.array(_WIDTHS)[np.minimum(np.searchsorted(_WIDTHS, lens), len(_WIDTHS) - 1)],
                        -(-lens // _WIDTHS[-1]) * _WIDTHS[-1])
    for w in np.unique(width_of):
        group = np.flatnonzero(width_of == w)
        for lo in range(0, len(group), max(1, 500_000 // int(w))):
            g = group[lo:lo + max(1, 500_000 // int(w))]
            if w > _WIDTHS[-1] and len(group) < _FEW:
                for j in g:
                    a = starts[first[j]]
                    score[j], second_best, ids = walk(v, data[a:a + lens[j]])
                    gap[j] = score[j] - second_best
                    piece_lists.append(ids)
                    count[j], order_of[j] = len(ids), flat_base
                    flat_base += len(ids)
                continue
            at = starts[first[g]][:, None] + np.arange(w)
            units = np.where(np.arange(w) < lens[g][:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
            best, second, step = viterbi(v, units)
            col = np.arange(len(g))
            score[g] = best[lens[g], col]
            gap[g] = score[g] - second[lens[g], col]
            # all best paths are followed back together; a character's bytes are one entry each
            pos = lens[g].copy()
            parts_unit, parts_id = [], []
            while True:
                live = np.flatnonzero(pos > 0)
                if not len(live):
                    break
                k = step[pos[live], live].astype(np.int64)
                size = np.abs(k)
                s = pos[live] - size
                whole = live[k > 0]
                ids = np.zeros(len(live), np.int64)
                if len(whole):
                    ids[k > 0] = _piece_ids(v, units, whole, s[k > 0], size[k > 0])
                single = k < 0
                # bytes of one character, last first
                for j in range(int(size[single].max()) if single.any() else 0):
                    here = live[single & (size > j)]
                    b = units[here, (pos[here] - 1 - j)]
                    parts_unit.append(here)
                    parts_id.append(v.byte_ids[b])
                parts_unit.append(whole)
                parts_id.append(ids[k > 0])
                pos[live] = s
            # entries came last piece first in every unit
            u = np.concatenate(parts_unit)[::-1]
            ids = np.concatenate(parts_id)[::-1]
            o = np.argsort(u, kind="stable")
            piece_lists.append(ids[o])
            c = np.bincount(u, minlength=len(g))
            count[g] = c
            order_of[g] = flat_base + np.cumsum(c) - c
            flat_base += int(c.sum())
    flat = np.concatenate(piece_lists) if piece_lists else np.zeros(0, np.int64)
    c = count[unit_of]
    total = int(c.sum())
    src = np.repeat(order_of[unit_of] - (np.cumsum(c) - c), c) + np.arange(total)
    ids = flat[src].astype(np.int32)
    piece_at = np.concatenate([[0], np.cumsum(c)])
    id_offsets = piece_at[row_units]
    sums = np.concatenate([[0], np.cumsum(score[unit_of])])
    totals = np.zeros(rows)
    has = np.diff(row_units) > 0
    totals[has] = np.add.reduceat(score[unit_of], row_units[:-1][has]) if has.any() else 0
    assert len(sums) == len(piece_at)
    alternatives = []
    for r in range(rows):
        a, b = row_units[r], row_units[r + 1]
        if n <= 1 or a == b:
            alternatives.append([])
            continue
        gaps = gap[unit_of[a:b]]
        near = np.arange(b - a) if b - a < n else np.sort(np.argpartition(gaps, n - 2)[:n - 1])
        lists = []
        for i in near:
            raw = bytes(data[starts[a + i]:ends[a + i]])
            if raw not in cache:
                if len(cache) > 20_000:
                    cache.clear()
                cache[raw] = n_best(v, raw, n)
            lists.append(cache[raw])
        out = []
        for value, chosen in combine([[s for s, _ in x] for x in lists], n)[1:]:
            edits = [{"first": int(piece_at[a + near[j]] - piece_at[a]), "count": int(c[a + near[j]]),
                      "ids": lists[j][x][1]} for j, x in enumerate(chosen) if x]
            out.append({"score": float(totals[r] + value - sum(x[0][0] for x in lists)), "edits": edits})
        alternatives.append(out)
    return ids, id_offsets, totals, alternatives


def _piece_ids(v: Vocabulary, units, rows, starts, sizes) -> np.ndarray:
    """Ids of the pieces at the given spans of the units."""
    h = np.zeros(len(rows), np.uint64)
    for j in range(int(sizes.max())):
        on = j < sizes
        byte = units[rows, np.minimum(starts + j, units.shape[1] - 1)]
        h = np.where(on, h * _BASE + byte + _U(1), h)
    return v.find(bytesx.mix(h + sizes.astype(np.uint64))).astype(np.int64)


_ALTERNATIVE = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct(
    [("first", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
ENCODED = ("array<int>", "double", "array<struct<score: double, edits: array<struct<first: int, count: int, "
           "ids: array<int>>>>>")


def encode(df: DataFrame, vocabulary: Vocabulary, keep: list[str], text_col: str = "text", n: int = 4,
           names: tuple[str, str, str] = ("ids", "score", "alternatives")) -> DataFrame:
    """``keep`` columns, ``ids`` and ``score`` of the best segmentation, and the n - 1 next best, under ``names``.

    An alternative replaces ``count`` of the best pieces from ``first`` on by ``ids``, for each of its edits.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    cache: dict = {}
    taken, place = scanned(df, keep, text_col)

    def one(b):
        v = shared.value
        raw, off = bytesx.column_bytes(b.column(place))
        for lo, hi in bytesx.slices(off, 2 * SLICE_BYTES):
            size = np.diff(off[lo:hi + 1])
            lead = (size > 0).astype(np.int64)
            o = np.concatenate([[0], np.cumsum(size + lead)])
            data = np.full(int(o[-1]), 0x20, np.uint8)
            inside = np.ones(len(data), bool)
            inside[o[:-1][size > 0]] = False
            data[inside] = raw[off[lo]:off[hi]]
            ids, at, score, more = encode_slice(v, data, o, n, cache)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(lo, hi - lo) for c in range(len(keep))),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(score),
                 pa.array(more, _ALTERNATIVE)], [*keep, *names])

    return map_batches(taken, one, fields + ", ".join(f"`{c}` {t}" for c, t in zip(names, ENCODED, strict=True)))


def decode_ids(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Text of each row of ids."""
    ok = (ids >= 0) & (ids < len(v.size))
    i = np.where(ok, ids, 0)
    size = np.where(ok, v.size[i], 0)
    at = np.concatenate([[0], np.cumsum(size)])
    src = np.repeat(v.at[i] - at[:-1], size) + np.arange(int(at[-1]))
    data = v.text[src]
    bounds = at[offsets]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        text = data[a:b].tobytes()
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return out


def decode(df: DataFrame, vocabulary: Vocabulary, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``, the text of the ids; null ids count as none."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def one(b):
        v = shared.value
        lists = b.column(len(keep))
        n = b.num_rows
        for lo in range(0, n, 512):
            part = lists.slice(lo, 512)
            size = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = part.flatten().fill_null(-1).to_numpy().astype(np.int64)
            texts = decode_ids(v, ids, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(lo, 512) for c in range(len(keep))), pa.array(texts, pa.string())],
                [*keep, "text"])

    return map_batches(df.select(*keep, F.col(ids_col).cast("array<int>").alias("_llm_ids")), one, fields + "text string")
