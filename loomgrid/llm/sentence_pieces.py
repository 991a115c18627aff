"""SentencePiece encoding and decoding, and distinct sampled segmentations.

Encoding and decoding give the library's ids and texts. Pieces never cross from
a word into the next space, so the library is asked for distinct chunks (spaces
with the word behind them) and texts are put together by lookup.

Sampling draws k segmentations of a whole text without replacement, by Gumbel
top-k: a perturbed A-star search over the lattice of all segmentations into
pieces (bytes for unknown characters). Lattice nodes are positions in chunks;
backward sums make the edge weights into transition probabilities. The search
keeps, for each step of a path, the greatest perturbed score among the siblings
it left (a Gumbel truncated by the path's own score). The path with the greatest
score is the first sample; the best sibling set left over is where the next one
branches off, and so on. The best score that is left after k samples is the
threshold of the inclusion scores: log q = log(1 - exp(-exp(log p - threshold))).

Random numbers are hashes of the row key (doc_id), the sample, the chunk and the
step, so results don't depend on partitions. All words of a slice of texts take
a step together in numpy.

Defined results: null and empty texts have no ids and one, empty, segmentation;
a null doc_id counts as key 0; repeated rows get equal results; U+2581 in a text
stands for a space, as in the library (round_trip is then false); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .chunk_table import ChunkTable
from .workspace import tune

SPACE_MARK = "▁"
SAMPLES = 2
#: Lattices of so many chunks are made at once.
_TOGETHER = 8192
#: So many chunks keep their lattices (some 700 bytes each), and so many bytes of text are sampled at once (some 300 bytes for each): neither changes a result.
KEPT_CHUNKS, SLICE_BYTES = 90_000, 1 << 18
_CHUNK = re.compile(rb" *[^ ]+| +")
_MARK_BYTES = SPACE_MARK.encode()


class Vocabulary:
    """Pieces of a model file: a trie over characters, weights, and bytes for decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.n = m.get_piece_size()
        self.space_id = m.piece_to_id(SPACE_MARK)
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        # Pieces are in order of merging, so about by frequency: weight 1 / (1 + rank), for bytes that of the last rank.
        self.weight = np.full(n, -np.log(1.0 + n))
        children: list[dict[str, int]] = [{}]
        accept = [-1]
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i)):
                self.bytes_of[i] = piece.replace(SPACE_MARK, " ").encode()
                self.weight[i] = -np.log1p(min(-m.get_score(i), n))
                at = 0
                for c in piece:
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                        accept.append(-1)
                    at = children[at][c]
                accept[at] = i
        self.spaced = np.array([b.startswith(b" ") and not m.is_byte(i) for i, b in enumerate(self.bytes_of)])
        letters = sorted({c for x in children for c in x})
        self.kinds = len(letters) + 1
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.kinds)
        self.root = np.zeros(self.kinds, np.int32)
        for c, to in children[0].items():
            self.root[self.kind[ord(c)]] = to
        moves = sorted((s * self.kinds + int(self.kind[ord(c)]), to) for s, out in enumerate(children) if s for c, to in out.items())
        self.keys, self.to = np.array([k for k, _ in moves]), np.array([t for _, t in moves], np.int32)
        self.accept = np.array(accept, np.int32)
        # Moves by the letters of lowest code points (ASCII and Latin-1) as a table; the others are searched in ``keys``.
        self.near = min(192, self.kinds)
        self.table = np.zeros((len(children), self.near), np.min_scalar_type(len(children)))
        low = self.keys % self.kinds < self.near
        self.table[self.keys[low] // self.kinds, self.keys[low] % self.kinds] = self.to[low]
        self.longest = max(len(m.id_to_piece(i)) for i in range(n))
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_lengths = np.array([len(b) for b in self.bytes_of])
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths

    def moved(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The state after one more letter, 0 for none."""
        near = kind < self.near
        if near.all():
            return self.table[state, kind].astype(np.int32)
        out = np.zeros(len(state), np.int32)
        out[near] = self.table[state[near], kind[near]]
        key = state[~near].astype(np.int64) * self.kinds + kind[~near]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[~near] = np.where(self.keys[place] == key, self.to[place], 0)
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list:
        """The library's ids of each chunk.

        The library puts a space before what it gets, but for nothing. Chunks
        with one space are put together and encoded at once: each gives just one
        piece that begins with the space, its first.
        """
        out: list = [None] * len(chunks)
        simple = [i for i, c in enumerate(chunks) if c[1:2] not in (b" ", b"")]
        for a in range(0, len(simple), 2000):
            some = simple[a : a + 2000]
            ids = self.model.encode(b"".join([chunks[i] for i in some])[1:].decode(), num_threads=1)
            starts = np.flatnonzero(self.spaced[ids]).tolist()
            for i, x, y in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                out[i] = ids[x:y]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.model.encode([chunks[i][1:].decode() for i in rest], num_threads=1), strict=True):
            out[i] = ids if chunks[i] != b" " else [self.space_id]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts given by their ids; the space that encoding puts first is taken off."""
        length = self.byte_lengths[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat_bytes[np.arange(total) + np.repeat(self.byte_starts[ids] - ends + length, length)]
        edge = np.r_[0, ends][offsets]
        first = edge[:-1][np.diff(edge) > 0]
        first = first[out[first] == 0x20]
        keep = np.ones(total, bool)
        keep[first] = False
        return out[keep], np.r_[0, np.cumsum(keep)][edge]


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncated(mean: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable about ``mean`` given that it is below ``most``; -inf where the mean is."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = mean - np.logaddexp(mean - most, np.log(-np.log(u)))
    return np.where(np.isneginf(mean), -np.inf, out)


def uniform(key: np.ndarray, sample: int, purpose: int, chunk: np.ndarray | int, step: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) by hash of the row key and counters."""
    x = np.asarray(chunk).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(step).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(sample * 8 + purpose + 1)
    return ((tb.mix(key + tb.mix(np.atleast_1d(x))) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattices(ChunkTable):
    """A table of chunks that also holds the lattice of each: nodes by character, edges by node, longer pieces first."""

    def __init__(self, words: Vocabulary, most: int = KEPT_CHUNKS):
        self.words = words
        super().__init__(words.encode_chunks, most)

    def _back(self, count: int, used: int) -> None:
        super()._back(count, used)
        self.n_nodes = int(self.first_node[count])
        self.n_edges = int(self.first_edge[self.n_nodes])

    def _start(self) -> None:
        super()._start()
        self.first_node = np.zeros(1 << 14, np.int64)
        self.n_nodes = self.n_edges = 0
        self.first_edge = np.zeros(1 << 16, np.int64)  # by node
        self.goal = np.zeros(1 << 17, np.int32)  # by edge: next node or -1
        self.symbol = np.zeros(1 << 17, np.int32)  # piece, or vocabulary size + character
        self.logp = np.zeros(1 << 17)
        self.upto = np.zeros(1 << 17, np.float32)  # probability of this and the edges before it

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        """The array with room for ``more`` behind ``used`` entries; what is not used yet takes no memory."""
        array = getattr(self, name)
        if used + more > len(array):
            larger = np.empty(2 * (used + more), array.dtype)
            larger[:used] = array[:used]
            setattr(self, name, larger)
            return larger
        return array

    def _learn(self, fresh: list[bytes]) -> None:
        had = self.count
        super()._learn(fresh)
        for at in range(0, len(fresh), _TOGETHER):
            self._add(fresh[at : at + _TOGETHER], had + at)

    def _add(self, fresh: list[bytes], had: int) -> None:
        """Lattices of the chunks with the places from ``had`` on."""
        v = self.words
        raw = b"".join(fresh)
        chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        sizes = np.diff(chars[np.r_[0, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))]])
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).copy()
        points[points == 0x20] = ord(SPACE_MARK)
        n = len(points)
        end = np.repeat(np.cumsum(sizes), sizes)
        kind = v.kind[points]
        at = np.arange(n)
        state = v.root[kind]
        piece = v.accept[state]
        known = (state > 0) & (piece >= 0)
        whole = np.where(known, piece, v.n + points.astype(np.int64))  # an unknown character stands for its bytes
        found = [(at, whole)]  # by length: sources and symbols
        alive = np.flatnonzero(state > 0)
        state = state[alive]
        for size in range(2, v.longest + 1):
            ok = alive + size <= end[alive]
            alive, state = alive[ok], state[ok]
            if not len(alive):
                break
            state = v.moved(state, kind[alive + size - 1])
            ok = state > 0
            alive, state = alive[ok], state[ok]
            piece = v.accept[state]
            good = piece >= 0
            found.append((alive[good], piece[good]))
        edges_of = np.bincount(np.concatenate([x for x, _ in found]), minlength=n)
        head = np.cumsum(edges_of) - edges_of
        m = int(edges_of.sum())
        source = np.repeat(at, edges_of)
        length, symbol, fill = np.empty(m, np.int32), np.empty(m, np.int64), head.copy()
        for size, (x, what) in reversed(list(enumerate(found, 1))):  # longer pieces first
            slot = fill[x]
            length[slot], symbol[slot] = size, what
            fill[x] += 1
        n_bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        weight = np.where(symbol < v.n, v.weight[np.minimum(symbol, v.n - 1)], n_bytes[source] * v.weight[v.byte_id[0]])
        goal = source + length
        last = goal == end[source]
        goal[last] = n  # where the backward sum is 0
        # Backward sums by distance to the end of the chunk.
        away = end - at
        by = np.argsort(away.astype(np.uint16) if away.max(initial=0) < 1 << 16 else away, kind="stable")
        bounds = np.searchsorted(away[by], np.arange(1, int(away.max(initial=0)) + 2))
        back = np.zeros(n + 1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s = by[a:b]
            if a == b:
                continue
            k = edges_of[s]
            first = np.cumsum(k) - k
            e = np.arange(first[-1] + k[-1]) + np.repeat(head[s] - first, k)
            value = weight[e] + back[goal[e]]
            top = np.maximum.reduceat(value, first)
            back[s] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, k)), first))
        logp = np.minimum(weight + back[goal] - back[source], 0.0)
        sums = np.r_[0.0, np.cumsum(np.exp(logp))]
        upto = sums[1:] - np.repeat(sums[head], edges_of)
        upto[head + edges_of - 1] = 2.0
        logp[head[edges_of == 1]] = 0.0

        self._room("first_node", had, len(fresh))[had : had + len(fresh)] = self.n_nodes + np.cumsum(sizes) - sizes
        self._room("first_edge", self.n_nodes, n + 1)[self.n_nodes : self.n_nodes + n] = self.n_edges + head
        self.first_edge[self.n_nodes + n] = self.n_edges + m
        span = slice(self.n_edges, self.n_edges + m)
        self._room("goal", self.n_edges, m)[span] = np.where(last, -1, self.n_nodes + goal)
        self._room("symbol", self.n_edges, m)[span] = symbol
        self._room("logp", self.n_edges, m)[span] = logp
        self._room("upto", self.n_edges, m)[span] = upto
        self.n_nodes += n
        self.n_edges += m

    def walk(self, key: np.ndarray, ordinal: np.ndarray, node: np.ndarray, step: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, step, edge) of random paths from ``node`` (-1: none) to the end of each chunk."""
        live = np.flatnonzero(node >= 0)
        node, step = node[live], step[live]
        chunks, steps, edges = [], [], []
        while len(live):
            u = uniform(key[live], sample, 0, ordinal[live], step)
            edge = self.first_edge[node].copy()
            open_ = np.flatnonzero(u > self.upto[edge])
            while len(open_):
                edge[open_] += 1
                open_ = open_[u[open_] > self.upto[edge[open_]]]
            chunks.append(live)
            steps.append(step)
            edges.append(edge)
            node = self.goal[edge]
            on = node >= 0
            live, node, step = live[on], node[on], step[on] + 1
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (chunks, steps, edges))

    def ids(self, edges: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of paths, edges in order."""
        v = self.words
        symbol = self.symbol[edges]
        if not (symbol >= v.n).any():
            return symbol.astype(np.int32), np.searchsorted(text, np.arange(n_texts + 1))
        rare = np.flatnonzero(symbol >= v.n)  # unknown characters: their bytes
        points = symbol[rare] - v.n
        size = np.ones(len(symbol), np.int64)
        size[rare] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        end = np.cumsum(size)
        out = np.empty(int(end[-1]), np.int32)
        out[end - size] = np.minimum(symbol, v.n)
        ends = np.cumsum(size[rare])
        to = np.arange(ends[-1]) + np.repeat(end[rare] - ends, size[rare])
        out[to] = v.byte_id[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
        return out, np.searchsorted(np.repeat(text, size), np.arange(n_texts + 1))


class Path:
    """A segmentation of every text of a slice: its edges in order, and the scores of the sibling sets from its branch on."""

    def __init__(self, table: Lattices, chunk, step, edge, first_chunk, key, score, from_step, sample):
        sizes = np.bincount(chunk, minlength=int(first_chunk[-1]))
        before_chunk = np.r_[0, np.cumsum(sizes)]
        to = before_chunk[chunk] + step
        self.edge, self.chunk = np.empty(len(edge), np.int32), np.repeat(np.arange(len(sizes)), sizes)
        self.edge[to] = edge
        self.first_step = before_chunk
        self.offsets = before_chunk[first_chunk]
        n = len(self.offsets) - 1
        logp = table.logp[self.edge]
        sums = np.r_[0.0, np.cumsum(logp)]
        start = sums[self.offsets[:-1]]
        self.logp = sums[self.offsets[1:]] - start
        self.score, self.sample = score, sample
        # What lies 60 below the path's score cannot come next within double precision.
        counts = np.diff(self.offsets)
        self.at = np.flatnonzero(sums[:-1] > np.repeat(start + score - 60.0, counts))
        self.text = np.searchsorted(self.offsets, self.at, "right") - 1
        place = self.at - self.offsets[self.text]
        new = place > from_step[self.text]
        self.at, self.text, place = self.at[new], self.text[new], place[new]
        self.before = sums[self.at] - start[self.text]
        with np.errstate(divide="ignore"):
            mean = self.before + np.log(-np.expm1(logp[self.at]))
        self.sets = _truncated(mean, score[self.text], uniform(key[self.text], sample, 1, place, 0))
        self.n = n

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(score, index) of the best sibling set of each text."""
        top = np.full(self.n, -np.inf)
        np.maximum.at(top, self.text, self.sets)
        where = np.full(self.n, -1)
        hit = np.flatnonzero((self.sets == top[self.text]) & (self.sets > -np.inf))
        where[self.text[hit][::-1]] = hit[::-1]
        return top, where

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.offsets))


def sample_paths(table: Lattices, chunks_of: list[list[bytes]], keys: np.ndarray, k: int) -> tuple[list[Path], np.ndarray]:
    """(k paths for all texts that ``table`` has looked up last, threshold by text); a path's score is -inf for texts that have no further segmentation."""
    n = len(chunks_of)
    counts = np.fromiter(map(len, chunks_of), np.int64, n)
    text_of = np.repeat(np.arange(n), counts)
    first_chunk = np.r_[0, np.cumsum(counts)]
    ordinal = np.arange(len(text_of)) - first_chunk[text_of]
    begin = table.first_node[table.at]
    key_of = keys[text_of]
    chunk, step, edge = table.walk(key_of, ordinal, begin, np.zeros(len(begin), np.int64), 0)
    paths = [Path(table, chunk, step, edge, first_chunk, keys, _gumbel(uniform(keys, 0, 2, 0, 0)), np.full(n, -1), 0)]
    taken: dict[tuple[int, int, int], list[int]] = {}
    for sample in range(1, k):
        tops, wheres = zip(*(p.best() for p in paths), strict=True)
        which = np.argmax(np.stack(tops), axis=0)
        score = np.stack(tops)[which, np.arange(n)]
        draw = uniform(keys, sample, 3, 0, 0)
        again = uniform(keys, sample, 4, 0, 0)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start = np.full(len(begin), -1, np.int64)
        at_step = np.zeros(len(begin), np.int64)
        from_step = np.full(n, 1 << 60)
        for t in np.flatnonzero(score > -np.inf).tolist():
            p = paths[which[t]]
            j = int(wheres[which[t]][t])
            i = int(p.at[j])
            e = int(p.edge[i])
            node = _source(table, e)
            lo, hi = int(table.first_edge[node]), int(table.first_edge[node + 1])
            out = taken.setdefault((t, int(which[t]), i), [e])
            weight = np.exp(table.logp[lo:hi])
            weight[np.array(out) - lo] = 0.0
            sums = np.cumsum(weight)
            chosen = lo + min(int(np.searchsorted(sums, draw[t] * sums[-1], "right")), int(np.flatnonzero(weight)[-1]))
            out.append(chosen)
            left = float(sums[-1] - weight[chosen - lo])
            weight[chosen - lo] = 0.0
            p.sets[j] = _truncated(np.array([p.before[j] + np.log(left)]), score[t : t + 1], again[t : t + 1])[0] if weight.any() and left > 0 else -np.inf
            a = int(p.offsets[t])
            chunks = p.chunk[a : i + 1]
            kept.append((chunks, np.arange(a, i + 1) - p.first_step[chunks], np.r_[p.edge[a:i], chosen]))
            c = int(p.chunk[i])
            last = int(first_chunk[t + 1])
            start[c + 1 : last] = begin[c + 1 : last]
            start[c] = table.goal[chosen]
            at_step[c] = i - p.first_step[c] + 1
            from_step[t] = i - a
        walked = table.walk(key_of, ordinal, start, at_step, sample)
        joined = (np.concatenate([x, *y]) for x, y in zip(walked, zip(*kept, strict=True) if kept else ((), (), ()), strict=True))
        paths.append(Path(table, *joined, first_chunk, keys, score, from_step, sample))
    return paths, np.max(np.stack([p.best()[0] for p in paths]), axis=0)


def _source(table: Lattices, edge: int) -> int:
    return int(np.searchsorted(table.first_edge[: table.n_nodes], edge, "right")) - 1


def chunks_of_text(raw: bytes) -> list[bytes]:
    return _CHUNK.findall(b" " + raw.replace(_MARK_BYTES, b" ")) if raw else []


def log_inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log of 1 - exp(-exp(logp - threshold)); 0 where nothing was left out."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        a = logp - threshold
        return np.where(np.isneginf(threshold), 0.0, np.where(a < -30, a, np.log(-np.expm1(-np.exp(np.minimum(a, 700))))))


def _slices(batches: Iterator[pa.RecordBatch], table: Lattices):
    for part in tb.slices(batches, most=SLICE_BYTES):
        data, off = tb.column_bytes(part.column("text"))
        raw = data.tobytes()
        chunks = [chunks_of_text(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ids, offsets = table.texts(chunks)
        yield part, data, off, chunks, ids, offsets


_CACHE: dict[str, Vocabulary] = {}
#: A Python worker keeps its table from task to task.
_TABLES: dict[str, Lattices] = {}


def vocabulary(model_path: str) -> Vocabulary:
    if model_path not in _CACHE:
        _CACHE[model_path] = Vocabulary(model_path)
    return _CACHE[model_path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>)."""
    tune(docs.sparkSession)

    def run(batches):
        table = ChunkTable(vocabulary(model_path).encode_chunks)
        for part, _, _, _, ids, offsets in _slices(batches, table):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""

    def run(batches):
        words = vocabulary(model_path)
        for batch in batches:
            column = batch.column("ids")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, off = words.decode(column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)])
            raw, off = data.tobytes(), off.tolist()
            texts = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(off[:-1], off[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, n_samples int, sample_n_ids array<long>, sample_crc32 array<long>, sample_log_prob array<double>, sample_log_inclusion array<double>"


def _crcs(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    raw, at = memoryview(ids.astype("<u4")).cast("B"), (4 * offsets).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def report(docs: DataFrame, model_path: str, k: int = SAMPLES) -> DataFrame:
    """One row for each document: its ids (number and CRC-32), whether decoding gives the text again, and k distinct sampled segmentations with log probability and log inclusion score."""
    tune(docs.sparkSession)

    def run(batches):
        words = vocabulary(model_path)
        if model_path not in _TABLES:
            _TABLES[model_path] = Lattices(words)
        table = _TABLES[model_path]
        for part, data, off, chunks, ids, offsets in _slices(batches, table):
            n = part.num_rows
            text, at = words.decode(ids, offsets)
            same = (at == off).all() and len(text) == len(data) and (text == data).all()
            trip = [True] * n if same else [text[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], off[:-1], off[1:], strict=True)]
            docs_ = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            paths, threshold = sample_paths(table, chunks, tb.mix(docs_.view(np.uint64) + np.uint64(1)), k)
            have = np.stack([np.isfinite(p.score) for p in paths])
            parts = []
            for p in paths:
                sampled, edges = table.ids(p.edge, p.texts(), n)
                parts.append((np.diff(edges).tolist(), _crcs(sampled, edges), np.round(p.logp, 6).tolist(), np.round(log_inclusion(p.logp, threshold), 6).tolist()))
            rows = have.T.tolist()
            lists = [[[x[c][i] for x, ok in zip(parts, row, strict=True) if ok] for i, row in enumerate(rows)] for c in range(4)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(_crcs(ids, offsets), pa.int64()), pa.array(trip), pa.array(have.sum(axis=0).astype(np.int32)), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True))],
                names=[x.split()[0] for x in REPORT.split(", ")],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, REPORT)
