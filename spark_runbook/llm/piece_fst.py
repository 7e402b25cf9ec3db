"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (the model's character map as longest replacements, runs of spaces, leading mark, spaces
to marks), the pieces (a letter tree in one hash table, whose final states write a piece at the cost of minus its score), and byte fallback (a letter
that is no piece writes its bytes' ids). Composed with an input they give a lattice, and the encoding is its shortest path in the tropical semiring,
relaxed place by place.

In a unigram model a state is a place in the input. In a merge (BPE) model, costs alone don't give the merges' result, so an arc into a piece that can't
stand behind the piece before it costs infinitely much. Which pairs may touch is read off the compiled splits: the merges of both pieces are undone from the last
to the first, and no pair at the seam may have been due earlier. Every beginning of a text has one encoding, so one piece of finite cost ends at each place, and a
state is a place here as well.

Many inputs are composed and relaxed at a time, as arrays. Where no piece crosses from a letter to a mark (checked), words compose on
their own, each new one once, and their paths are kept in a bounded cache.

Defined results: null counts as empty, which has no ids; a literal mark (U+2581) in a text decodes to a space, so such a text doesn't come
back the same; with a character map, decoding gives the normalised text; repeated rows are encoded one by one; an empty table gives an empty
result; models with user-defined pieces, which bypass the costs, are refused.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, give_back, small_batches, text_or_empty
from .shingles import chunks

MARK = "▁"
#: Fixed value: a letter that is no piece costs this much more than the piece of the least score.
UNKNOWN_PENALTY = 10.0
CACHE = 200_000
WORD_CHARS = 60
LONG = 200
WINDOW = 1 << 16
GAP = 0x1FFFFF
LOG2_PAIRS = 19


class IntTable:
    """Whole numbers to numbers, looked up many at a time: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.log2 = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.log2, -1, np.int64), np.full(1 << self.log2, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[todo[placed]], values[todo[placed]]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log2)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        more = np.flatnonzero((at != keys) & (at >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[more]]
            hit = at == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (at >= 0)]
        return out


def character_map(blob: bytes) -> dict[str, str]:
    """Replacements of a model's character map: a double-array tree of UTF-8 strings, and behind it their texts, each closed by a zero byte."""
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    letters = np.arange(1, 256)
    found, at, keys = {}, offset(units[:1]), [b""]
    while len(at):
        to = (at[:, None] ^ letters).ravel()
        here = to < len(units)
        here[here] = (units[to[here]] & ((1 << 31) | 255)) == np.tile(letters, len(at))[here]
        keys = [keys[i // 255] + bytes([i % 255 + 1]) for i in np.flatnonzero(here).tolist()]
        unit = units[to[here]]
        at = to[here] ^ offset(unit)
        for k, end in zip(np.flatnonzero(unit >> 8 & 1).tolist(), (units[at[(unit >> 8 & 1) == 1]] & 0x7FFFFFFF).tolist(), strict=True):
            found[keys[k].decode()] = texts[end : texts.index(0, end)].decode()
    return found


class PieceTransducer:
    def __init__(self, path: str | None = None, model: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        m.ParseFromString(model)
        kind = pb.ModelProto.SentencePiece
        refused = {
            "user-defined pieces": any(p.type == kind.USER_DEFINED for p in m.pieces),
            "words or characters as pieces": m.trainer_spec.model_type not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM),
            "marks behind words": m.trainer_spec.treat_whitespace_as_suffix,
            "no byte fallback": not m.trainer_spec.byte_fallback or sum(p.type == kind.BYTE for p in m.pieces) < 256,
            "unused pieces and merges": m.trainer_spec.model_type == pb.TrainerSpec.BPE and any(p.type == kind.UNUSED for p in m.pieces),
        }
        if why := [k for k, v in refused.items() if v]:
            raise ValueError(f"this model isn't handled: it has {', '.join(why)}")
        self.map = character_map(m.normalizer_spec.precompiled_charsmap) if m.normalizer_spec.precompiled_charsmap else {}
        self.longest: dict[str, int] = {}
        for k in self.map:
            self.longest[k[0]] = max(len(k), self.longest.get(k[0], 0))
        self.mapped = re.compile("[" + "".join(map(re.escape, self.longest)) + "]") if self.map else None
        self.prefix = MARK if m.normalizer_spec.add_dummy_prefix else ""
        self.squeeze = m.normalizer_spec.remove_extra_whitespaces
        self.merges = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        usable = {i: p for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(MARK, " ").encode() if i in usable else b"" for i, p in enumerate(m.pieces)]
        self.word_level = not any(MARK in p.piece.lstrip(MARK) for p in usable.values())
        self.line_level = not any("\n" in p.piece for p in usable.values())
        self.inner: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self._compile({p.piece: (i, p.score) for i, p in usable.items()})

    def _compile(self, pieces: dict[str, tuple[int, float]]) -> None:
        """The tables of the machines. Pieces are numbered anew; letters that only occur in longer pieces get numbers too, and write their bytes."""
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.fallback = UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        split = {p: self._last_merge(p) for p in pieces if len(p) > 1} if self.merges else {}
        live = [p for p in pieces if len(p) == 1 or not self.merges or split[p]]  # no path leads through a piece that merging never makes
        live += sorted({c for p in live for c in p} - set(live))
        self.number = {p: k for k, p in enumerate(live)}
        n = len(live)
        self.ids = np.array([pieces[p][0] if p in pieces else -1 for p in live], np.int64)
        self.size = np.array([len(p) for p in live], np.int32)
        self.cost = np.array([(-self.score[p] if not self.merges else 1.0) if p in pieces else self.fallback for p in live])
        nodes, keys, final = {"": 0}, [], {}
        for k, p in enumerate(live):
            for j, c in enumerate(p):
                if (to := p[: j + 1]) not in nodes:
                    keys.append((nodes[p[:j]] << 21 | ord(c), len(nodes)))
                    nodes[to] = len(nodes)
            final[nodes[p]] = k
        self.tree = IntTable(*(np.array(x, np.int64) for x in zip(*keys, strict=True)))
        self.final = np.full(len(nodes), -1, np.int32)
        self.final[list(final)] = list(final.values())
        if self.merges:
            order = {s: r for r, s in enumerate(sorted({-self.score[p] for p in live if len(p) > 1}))}
            self.rank = np.array([order[-self.score[p]] if len(p) > 1 else -1 for p in live], np.int64)
            self.left, self.right = (np.array([self.number[split[p][side]] if len(p) > 1 else k for k, p in enumerate(live)], np.int64) for side in (0, 1))
            whole = np.flatnonzero(self.rank >= 0)
            self.joined = IntTable(self.left[whole] * n + self.right[whole], whole)
            self.seen = np.full(1 << LOG2_PAIRS, -1, np.int64)

    def _last_merge(self, letters: str) -> tuple[str, str] | None:
        """The two parts that merging joins last (best score first, then leftmost) to give the letters, or None if it never does."""
        part, last = list(letters), None
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            last = (a, b)
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return last if part[0] == letters else None

    def touch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand right behind piece a, of arrays of pieces (-1: a letter in no piece, which may stand anywhere).

        The later one of the two's last merges is undone, again and again, down to letters. A piece of both sides of the seam that was due before the
        merge just undone would have been made first; at equal scores the left one is."""
        key = a * len(self.ids) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - LOG2_PAIRS)).astype(np.int64)
        known = self.seen[slot]
        ok = (a < 0) | (b < 0) | (known == 2 * key + 1)
        at = np.flatnonzero((a >= 0) & (b >= 0) & (known >> 1 != key))
        new = np.ones(len(at), bool)
        k, x, y, limit = np.arange(len(at)), a[at], b[at], np.full(len(at), 1 << 60)
        while len(k):
            over = self.joined.get(x * len(self.ids) + y)
            bad = (over >= 0) & (self.rank[over] < limit)
            new[k[bad]] = False
            on = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            k, x, y = k[on], x[on], y[on]
            undo = self.rank[x] > self.rank[y]
            limit = np.where(undo, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        ok[at] = new
        self.seen[slot[at]] = 2 * key[at] + new
        return ok

    def compose(self, letters: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattice over code points: places where arcs begin (before ``starts``) and end, and their pieces (-1: a letter in no piece)."""
        at = np.flatnonzero(letters[:starts] != GAP)
        node, begin, end, piece, depth = np.zeros(len(at), np.int64), [], [], [], 0
        while len(at):
            node = self.tree.get(node << 21 | letters[at + depth]).astype(np.int64)
            if depth == 0:
                begin.append(at[node < 0])
                end.append(begin[0] + 1)
                piece.append(np.full(len(begin[0]), -1, np.int64))
            at, node, depth = at[node >= 0], node[node >= 0], depth + 1
            done = self.final[node]
            begin.append(at[done >= 0])
            end.append(begin[-1] + depth)
            piece.append(done[done >= 0].astype(np.int64))
            inside = at + depth < len(letters)
            at, node = at[inside], node[inside]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, end, piece))

    def _costs(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece < 0, self.fallback, self.cost[piece])

    def shortest_paths(self, units: list[str]) -> list[bytes]:
        """Ids (32 bits each) along the cheapest path of every unit: all are relaxed together, place by place."""
        sizes = np.array([len(u) for u in units], np.int64)
        letters = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        letters[first + sizes] = GAP
        begin, end, piece = self.compose(letters, len(letters))
        cost, last = np.full(len(letters), np.inf), np.full(len(letters), -1, np.int64)
        cost[first] = 0.0
        head = np.zeros(len(letters), bool)
        head[first] = True
        place = (end - np.repeat(first, sizes + 1)[end]).astype(np.int16)
        order = np.argsort(place, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        bounds = np.searchsorted(place[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            b, e, p = begin[lo:hi], end[lo:hi], piece[lo:hi]
            if self.merges:  # one arc into a place has a finite cost
                ok = self.touch(last[b], p)
                last[e[ok]] = p[ok]
                continue
            c = cost[b] + self._costs(p)
            best = np.lexsort((-b, -c, e))  # of the arcs into a place the cheapest, then the longest, is written last
            best = best[np.append(e[best][1:] != e[best][:-1], True)] if len(best) else best
            cost[e[best]], last[e[best]] = c[best], p[best]
        on, at = np.zeros(len(letters), bool), (first + sizes)[sizes > 0]
        while len(at):
            on[at] = True
            at = at - np.where(last[at] < 0, 1, self.size[last[at]])
            at = at[~head[at]]
        ends = np.flatnonzero(on)
        return self._written(letters, ends, last[ends], np.searchsorted(ends, first, side="right"), np.searchsorted(ends, first + sizes, side="right"))

    def _written(self, letters: np.ndarray, ends: np.ndarray, piece: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """The ids that a path's pieces write, from lo to hi for each unit; letters without an id write their bytes."""
        ids = np.where(piece < 0, -1, self.ids[piece])
        odd = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        texts = {int(c): [self.byte_ids[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(letters[ends[odd] - 1])}
        count[odd] = [len(texts[c]) for c in letters[ends[odd] - 1].tolist()]
        at = np.append(0, np.cumsum(count))
        out = np.repeat(ids, count)
        for k in odd.tolist():
            out[at[k] : at[k + 1]] = texts[int(letters[ends[k] - 1])]
        blob = out.astype("<u4").tobytes()
        return [blob[4 * x : 4 * y] for x, y in zip(at[lo].tolist(), at[hi].tolist(), strict=True)]

    def shortest_path(self, unit: str) -> bytes:
        """The same for one long unit, whose lattice is composed in windows: relaxed arc by arc, a number and a piece kept for each place."""
        letters = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4")
        n, most = len(letters), int(self.size.max(initial=1))
        cost, last, pairs = np.full(n + 1, np.inf), np.full(n + 1, -1, np.int32), {}
        cost[0] = 0.0
        for w in range(0, n, WINDOW):
            span = min(WINDOW, n - w)
            begin, end, piece = self.compose(letters[w : w + span + most].astype(np.int64), span)
            order = np.lexsort((end, begin))
            c, p = cost[w : w + span + most + 1].tolist(), last[w : w + span + most + 1].tolist()
            for b, e, k, x in zip(begin[order].tolist(), end[order].tolist(), piece[order].tolist(), self._costs(piece)[order].tolist(), strict=True):
                if c[b] + x >= c[e]:
                    continue
                if self.merges and (w or b):
                    if (ok := pairs.get((p[b], k))) is None:
                        if len(pairs) > CACHE:
                            pairs.clear()
                        ok = pairs[p[b], k] = bool(self.touch(np.array([p[b]]), np.array([k]))[0])
                    if not ok:
                        continue
                c[e], p[e] = c[b] + x, k
            cost[w : w + span + most + 1], last[w : w + span + most + 1] = c, p
        size, ends, at = self.size, [], n
        while at:
            ends.append(at)
            at -= int(size[last[at]]) if last[at] >= 0 else 1
        ends = np.array(ends[::-1], np.int64)
        return self._written(letters, ends, last[ends].astype(np.int64), np.array([0]), np.array([len(ends)]))[0]

    def normalise(self, text: str) -> str:
        """The text behind the character map, the longest replacement first, with runs of spaces shortened if the model says so."""
        if self.mapped:
            out, at = [], 0
            while found := self.mapped.search(text, at):
                i = found.start()
                size = next((k for k in range(self.longest[text[i]], 0, -1) if text[i : i + k] in self.map), 0)
                out += (text[at:i], self.map[text[i : i + size]] if size else text[i])
                at = i + max(size, 1)
            text = "".join(out) + text[at:]
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def _units(self, text: str) -> list[tuple[dict[str, bytes], list[str]]]:
        """What composes on its own, in order: lists of words with the cache that they are in (``inner``: behind a mark, ``bare``: as they are)."""
        if not (self.word_level and self.line_level):
            return [(self.bare, [self.prefix + text.replace(" ", MARK)])] if text else []
        out = []
        for i, line in enumerate(text.split("\n")):
            prefix = "" if i or not text else self.prefix
            if i:
                out.append((self.bare, ["\n"]))
            if MARK in line or "  " in line or line.startswith(" ") or line.endswith(" ") or (prefix and not line):
                for u in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", prefix + line.replace(" ", MARK)):
                    out.append((self.bare, [u]))
            elif line:
                words = line.split(" ")
                out += [(self.inner, words)] if prefix else [(self.bare, words[:1]), (self.inner, words[1:])]
        return out

    def _learn(self, cache: dict[str, bytes], new: list[str], mark: str) -> None:
        short = [u for u in new if len(u) < LONG]
        cache.update(zip(short, self.shortest_paths([mark + u for u in short]), strict=True) if short else ())
        cache.update((u, self.shortest_path(mark + u)) for u in new if len(u) >= LONG)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        units, once = [self._units(self.normalise(t)) for t in texts], []
        for cache, mark in ((self.inner, MARK), (self.bare, "")):
            if len(cache) > CACHE:
                cache.clear()
            every: set[str] = set()
            for parts in units:
                for c, keys in parts:
                    if c is cache:
                        every.update(keys)
            new = [u for u in every if u not in cache]
            self._learn(cache, new, mark)
            once += [(cache, u) for u in new if len(u) > WORD_CHARS]
        out = [np.frombuffer(b"".join([b"".join([c[k] for k in keys]) for c, keys in parts]), "<u4") for parts in units]
        for cache, u in once:
            del cache[u]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The inverse machine: letters and bytes of the ids, marks to spaces, the leading one dropped."""
        of = self.bytes_of
        out = b"".join([of[i] for i in ids.tolist()])
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def transducer(path: str) -> PieceTransducer:
    """One compiled machine for each Python worker and model, until the worker gets a task of another operator."""
    known = Kept.of.setdefault("piece_fst", {})
    if path not in known:
        known[path] = PieceTransducer(path)
    return known[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a row of docs: its id, ids (if asked for), n_ids, ids_crc32, decoded_crc32 and whether decoding gives the text back."""

    @functools.partial(give_back, keeps="piece_fst")
    def run(batches):
        t = transducer(model_path)
        for b in batches:
            for first, texts in chunks(b.column(1)):
                rows = []
                for raw, ids in zip(texts, t.encode_all([x.decode() for x in texts]), strict=True):
                    back = t.decode(ids).encode()
                    rows.append((ids, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back), back == raw))
                c = list(zip(*rows, strict=True))
                cols = [pa.array(c[0], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *cols, pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], names=[id_col, *["ids"] * with_ids, "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.dtypes[0][1]}, {'ids array<int>, ' if with_ids else ''}n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op2_piece_fst(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, model_path or public_tokenizers.path("piece_bpe_32k.model"))
